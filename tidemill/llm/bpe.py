"""Byte-level BPE by batched numpy merge rounds.

New words of a batch are put into one flat array of symbols. In each round all adjacent
pairs are looked up by binary search over the sorted pair keys of the vocabulary, the
lowest rank of each word is found, and all its occurrences in that word are merged; words
without a pair leave the array. Words met before come from a bounded table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import steps

#: Words that a task remembers, and the longest that it does (in characters).
WORDS, LONGEST = 400_000, 64
_NONE = np.iinfo(np.int64).max

# Fixed value: the published pattern that splits text into words before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others for U+0100 upwards in order.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """What encoding and decoding need of a tokenizer file: arrays of the vocabulary's size."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normaliser and added space is needed")
        ids, letters = model["vocab"], byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[order]) != 0] if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks, self.made = keys[order][first], order[first].astype(np.int64), made[order][first]
        self.of_byte = np.array([ids[letters[b]] for b in range(256)], np.int64)
        back = {c: b for b, c in letters.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes[i] = token.encode()


def merged(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The ids of each word (not empty), by merge rounds over all of them at once."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    if not words:
        return out
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    names = np.arange(len(words))
    ends = np.zeros(len(symbols), bool)
    ends[np.cumsum(lengths) - 1] = True
    ranks = np.full(len(symbols), _NONE)
    changed = np.flatnonzero(~ends)
    while len(names):
        # Only pairs of which a symbol is new are looked up; the others keep their ranks.
        if len(changed) and len(v.keys):
            pairs = symbols[changed] << 32 | symbols[changed + 1]
            found = np.minimum(np.searchsorted(v.keys, pairs), len(v.keys) - 1)
            ranks[changed] = np.where(v.keys[found] == pairs, v.ranks[found], _NONE)
        starts = np.cumsum(lengths) - lengths
        best = np.minimum.reduceat(ranks, starts)
        done = best == _NONE
        for i in np.flatnonzero(done).tolist():
            out[names[i]] = symbols[starts[i] : starts[i] + lengths[i]]
        if done.all():
            break
        of = np.repeat(np.arange(len(names)), lengths)
        at = np.flatnonzero((ranks == best[of]) & ~done[of])
        # Of overlapping occurrences (the same symbol three times or more) every second one is merged.
        begins = np.r_[True, np.diff(at) > 1]
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        keep = ~done[of]
        symbols[at] = v.made[np.searchsorted(v.keys, symbols[at] << 32 | symbols[at + 1])]
        ends[at] |= ends[at + 1]
        keep[at + 1] = False
        at = np.cumsum(keep)[at] - 1  # where the merged symbols come to be
        lengths = np.bincount(of[keep], minlength=len(names))[~done]
        symbols, ranks, ends, names = symbols[keep], ranks[keep], ends[keep], names[~done]
        ranks[at] = _NONE
        changed = np.unique(np.r_[at, at[at > 0] - 1])
        changed = changed[~ends[changed]]
    return out


class Words(dict):
    """Words and their ids; words of the texts at hand that are not held come from ``extra``."""

    def __init__(self) -> None:
        super().__init__()
        self.extra: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.extra[word]


class Encoder:
    """Encodes texts with one vocabulary; holds the words met so far."""

    def __init__(self, v: Vocabulary):
        self.v, self.held, self.split = v, Words(), regex.compile(PATTERN)
        self.added = regex.compile("|".join(map(regex.escape, sorted(v.added, key=len, reverse=True)))) if v.added else None

    def pieces(self, text: str) -> list[list[str] | int]:
        """Lists of words, and the ids of added tokens between them."""
        if self.added is None or not any(t in text for t in self.v.added):
            return [self.split.findall(text)]
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self.split.findall(text[at : m.start()]), self.v.added[m[0]]]
            at = m.end()
        return [*out, self.split.findall(text[at:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        new = set()
        for pieces in split:
            for p in pieces:
                if not isinstance(p, int):
                    new.update(p)
        met, new = new, list(new.difference(self.held))
        if len(self.held) >= WORDS and len(new) * 2 > len(met):
            # The texts have other words than those that are held, so all of theirs are made anew.
            self.held.clear()
            new = list(met)
        made = dict(zip(new, [ids.astype("<u4").tobytes() for ids in merged([w.encode() for w in new], self.v)], strict=True))
        room = max(0, WORDS - len(self.held))
        kept = [w for w in new if len(w) <= LONGEST][:room]
        self.held.update((w, made[w]) for w in kept)
        self.held.extra = made
        get = self.held.__getitem__
        out = [np.frombuffer(b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in pieces), "<u4") for pieces in split]
        self.held.extra = {}
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(4)
def _content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_column(docs: DataFrame, tokenizer_path: str, *, text: str = "text", digests: bool = False) -> DataFrame:
    """docs with ``ids`` (array<int>) and ``decoded``; with digests, n_tokens and the digests of both in their place.

    The result equals the library's: strings of added tokens become their ids, no tokens are
    added, and decoding keeps special tokens. Null counts as empty and has no ids. The file
    is read on the driver and broadcast; its size is that of the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_content(tokenizer_path))
    rest = [c for c in docs.columns if c != text] if digests else docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value))
        for batch in steps(batches, text):
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            ids = encoder.encode(texts)
            decoded = [encoder.decode(i) for i in ids]
            own = [batch.column(names.index(c)) for c in rest]
            if digests:
                made = [pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
                yield pa.RecordBatch.from_arrays([*own, *made], [*rest, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ends = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*own, lists, pa.array(decoded, pa.string())], [*rest, "ids", "decoded"])

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    clash = {x.split()[0] for x in made.split(", ")} & set(rest)
    if clash:
        docs = docs.withColumnsRenamed({c: f"input_{c}" for c in clash})
        return encode_column(docs, tokenizer_path, text=text, digests=digests)
    return docs.mapInArrow(run, f"{own}, {made}" if own else made)
