"""Fill-in-the-middle: texts cut at unit boundaries and put in another order between sentinels.

A unit is a run of ASCII letters or any other single code point. One table-driven automaton
over UTF-8 bytes tells unit starts, code points and sentinels in the same scan; its
transitions emit counts, and a second pass looks for the cuts only in the stretches of bytes
whose counts hold them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import flat, give_back, steps

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What a transition counts: the start of a unit, the start of a code point, the end of a sentinel.
UNIT, POINT, SENTINEL = 1, 2, 4
#: Bytes of a lane, the stretch that one state walks through. Lanes of a step advance together.
LANE = 512
#: A byte that UTF-8 does not have: between texts it takes every state to the start and counts nothing.
BREAK = 0xFF
#: Lanes whose counts the second pass looks into at once.
LOOKED = 4096


@dataclass(frozen=True)
class Automaton:
    """``after[state << 8 | byte]`` is the next state << 8, ``counts`` of the same index are its flags, ``reach`` the bytes that fix a state."""

    after: np.ndarray
    counts: np.ndarray
    reach: int


def automaton(sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> Automaton:
    """States are: between units, in a letter run, 1 to 3 bytes before the end of a code point, and each beginning of a sentinel."""
    words = [s.encode("ascii") for s in sentinels]
    begun = sorted({w[:i] for w in words for i in range(1, len(w))})
    for w in words:
        others = [v for v in words if v is not w]
        if not w or any(w in v for v in others) or any(w.endswith(b) for b in begun):
            raise ValueError(f"sentinels that overlap cannot be told apart: {sentinels}")
    other, letters, inside = 0, 1, 2  # inside + k: k + 1 bytes of a code point are to come
    names = [b"", b"", b"", b"", b"", *begun]
    after, counts = np.zeros((len(names), 256), np.uint16), np.zeros((len(names), 256), np.uint8)
    for state, had in enumerate(names):
        in_letters = state == letters or had[-1:].isalpha()
        for byte in range(256):
            to, flags = other, 0
            if 0x80 <= byte < 0xC0:
                to = state - 1 if inside < state <= inside + 2 else other
            elif byte >= 0xC2 and byte < 0xF5:
                to, flags = inside + (byte >= 0xE0) + (byte >= 0xF0), UNIT | POINT
            elif byte < 0x80:
                letter = chr(byte).isalpha()
                flags = POINT | (0 if letter and in_letters else UNIT)
                read = had + bytes((byte,))
                if any(read.endswith(w) for w in words):
                    flags |= SENTINEL
                tails = [read[i:] for i in range(len(read)) if read[i:] in begun]
                to = names.index(tails[0]) if tails else letters if letter else other
            after[state, byte], counts[state, byte] = to << 8, flags
    return Automaton(after.ravel(), counts.ravel(), max(3, *(len(w) - 1 for w in words)))


def scan(data: np.ndarray, machine: Automaton) -> np.ndarray:
    """The flags of every byte, as lanes of LANE bytes (the last one filled up with BREAK).

    All lanes take a step at a time. A lane's first state follows from the ``reach`` bytes before
    it alone, so lanes need not wait for each other.
    """
    n = max(1, -(-len(data) // LANE))
    held = np.full(machine.reach + n * LANE, BREAK, np.uint8)
    held[machine.reach : machine.reach + len(data)] = data
    begins = np.arange(n) * LANE
    state = np.zeros(n, np.uint16)
    for i in range(machine.reach):
        state = machine.after[state | held[begins + i]]
    lanes = np.ascontiguousarray(held[machine.reach :].reshape(n, LANE).T)
    flags = np.empty((LANE, n), np.uint8)
    for i in range(LANE):
        at = state | lanes[i]
        np.take(machine.counts, at, out=flags[i])
        np.take(machine.after, at, out=state)
    return np.ascontiguousarray(flags.T)


def unit_starts(flags: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The bytes at which the units of these numbers (from 0, over all lanes) start."""
    per_lane = np.count_nonzero(flags & UNIT, axis=1)
    before = np.cumsum(per_lane) - per_lane
    out = np.empty(len(ranks), np.int64)
    for i in range(0, len(ranks), LOOKED):
        some = ranks[i : i + LOOKED]
        lane = np.searchsorted(before, some, "right") - 1
        nth = np.cumsum(flags[lane] & UNIT, axis=1, dtype=np.int32)
        out[i : i + LOOKED] = lane * LANE + np.argmax(nth == (some - before[lane] + 1)[:, None], axis=1)
    return out


def draws(key: object, seed: int) -> list[int]:
    """Four unsigned 32-bit integers of a row's key; a null key is an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def _rows(data: np.ndarray, at: np.ndarray, keys: list, machine: Automaton, sentinels: tuple[bytes, bytes, bytes], seed: int, plain: int, spm: int) -> list[list]:
    """Columns n, form, prefix_chars, middle_chars and output (bytes) of the texts data[at[i]:at[i + 1]]."""
    n_texts = len(keys)
    stream = np.full(len(data) + n_texts, BREAK, np.uint8)
    starts = at[:-1] + np.arange(n_texts)  # a break follows each text
    stream[np.arange(len(data)) + np.repeat(np.arange(n_texts), np.diff(at))] = data
    flags = scan(stream, machine)
    line = flags.ravel()
    units = np.add.reduceat(line & UNIT, starts, dtype=np.int64) if n_texts else np.zeros(0, np.int64)
    marked = np.add.reduceat((line & SENTINEL) >> 2, starts, dtype=np.int64) if n_texts else np.zeros(0, np.int64)
    first = np.cumsum(units) - units
    forms, asked = [], np.empty((n_texts, 2), np.int64)
    for i, (key, n) in enumerate(zip(keys, units.tolist(), strict=True)):
        h1, h2, h3, h4 = draws(key, seed)
        forms.append("plain" if not n or marked[i] or h3 % 100 >= 100 - plain else "spm" if h4 % 100 < spm else "psm")
        asked[i] = sorted((h1 % (n + 1), h2 % (n + 1)))
    ends = starts + np.diff(at)
    cuts = np.repeat(ends[:, None], 2, axis=1)  # a cut after all units is the text's end
    cut = (asked < units[:, None]) & np.array([f != "plain" for f in forms], bool)[:, None]
    cuts[cut] = unit_starts(flags, (first[:, None] + asked)[cut])
    pre, suf, mid = sentinels
    raw, chars, middles, outputs = stream.tobytes(), [], [], []
    for form, a, z, (b, c) in zip(forms, starts.tolist(), ends.tolist(), cuts.tolist(), strict=True):
        if form == "plain":
            chars.append(None), middles.append(None), outputs.append(raw[a:z])
            continue
        chars.append(int(np.count_nonzero(line[a:b] & POINT)))
        middles.append(int(np.count_nonzero(line[b:c] & POINT)))
        prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:z]
        outputs.append(b"".join((pre, prefix, suf, suffix, mid, middle) if form == "psm" else (suf, suffix, pre, prefix, mid, middle)))
    return [units.tolist(), forms, chars, middles, outputs]


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    Both cuts are drawn from the key, so reruns agree and rows with the same key and text get the
    same. Null texts count as empty and stay plain with an empty output; so do (with their text)
    those that contain a sentinel and ``plain`` in 100 of the others. ``spm`` in 100 of the rest have the suffix first. A null key is drawn
    for as an empty string. Columns named like results come back as ``input_*``. Whole texts are
    worked on, a few megabytes or one text at a time.
    """
    pre, suf, mid = sentinels
    machine = automaton((pre, suf, mid))
    made = "n long, form string, prefix_chars long, middle_chars long, output string"
    docs = docs.withColumnsRenamed({c: f"input_{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output") if c in docs.columns and c not in (key, text)})
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            names = batch.schema.names
            data, at = flat(batch.column(names.index(text)))
            keys = batch.column(names.index(key)).to_pylist()
            *plainly, outputs = _rows(data, at, keys, machine, tuple(s.encode() for s in (pre, suf, mid)), seed, plain, spm)
            columns = [pa.array(c, t) for c, t in zip(plainly, types, strict=False)]
            columns.append(pa.array(outputs, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *(x.split()[0] for x in made.split(", "))])
        give_back()

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns)
    return docs.mapInArrow(run, f"{own}, {made}")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of: its parts between the sentinels, in their old order."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    one, two, three = (F.try_element_at(parts, F.lit(i)) for i in (2, 3, 4))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
