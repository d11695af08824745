"""Spelling variants: words one insertion, deletion or replacement apart, by full neighbourhood generation.

Every word's distinct neighbours over the observed alphabet are generated and looked up in the
vocabulary by hash, so no distances are computed. Candidates are not shuffled: a word is cut into
SEGMENTS parts, and an edit within one part leaves the others as they are, so a word and its
neighbours are dealt by the other parts and meet in one task, which generates the candidates of
that part's edits as 64-bit hashes, block by block, and looks them up in the words dealt to it.
A hit counts if the edited word is the word found, character by character.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import flat, give_back, lower_ascii, partitions, stored

#: Parts of a word: edits in one of them keep the others.
SEGMENTS = 3
#: Distinct words of texts that a task counts before it passes the counts on.
HELD = 400_000
#: Vocabulary words with the same key that one task holds; more are dealt by their own hash.
CROWD = 200_000
#: Candidate hashes of a block.
BLOCK = 1 << 20
#: Bits of the table that most candidates are turned away by, for each word of a task.
BITS = 16
#: Runs of letters in UTF-8: A-Z, a-z, and U+00C0 to U+00FF, which are C3 80 to C3 BF.
_RUN = rb"(?:[A-Za-z]|\xC3[\x80-\xBF])"
_TURN = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _letters() -> np.ndarray:
    """A 64-bit value for each code point below 256: the mixing steps of splitmix64 over its number."""
    x = np.arange(1, 257, dtype=np.uint64) * _TURN
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


LETTERS = _letters()


def counted_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 7, drop: int = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters and how often they come, counts of parts of the table.

    Of a run whose crc32 with its document's key ``drop`` divides, one letter is dropped, which is how
    variants come into test tables; 0 drops none. A null key is an empty string there. Null texts
    have no words. Runs of fewer than ``least`` letters cannot become words of ``least``.
    """
    run, lower = re.compile(_RUN + b"{%d,}" % least), lower_ascii()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()).cast(pa.string()), pa.array(list(totals.values()), pa.int64())], ["word", "n"])
            totals.clear()
            return made

        for batch in batches:
            data, at = flat(batch.column(1))
            data, ends = data.tobytes().translate(lower), at.tolist()
            for key, a, z in zip(batch.column(0).to_pylist(), ends, ends[1:], strict=False):
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(run.findall(data, a, z)).items():
                    if drop and (h := zlib.crc32(word, seed)) % drop == 0:
                        letters = word.decode()
                        k = h % len(letters)
                        if len(letters) == least:
                            continue
                        word = (letters[:k] + letters[k + 1 :]).encode()
                    totals[word] += n
                if len(totals) >= HELD:
                    yield passed()
        if totals:
            yield passed()
        give_back()

    return docs.select(key, text).mapInArrow(count, "word string, n long")


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 7, often: int = 2, drop: int = 31) -> DataFrame:
    """(word, n) of the words of ``least`` letters that come ``often`` times over all documents."""
    return counted_words(docs, key=key, text=text, least=least, drop=drop).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def dealt(words: DataFrame, n_parts: int) -> DataFrame:
    """(key, part, parts, segment, word, n): words to be looked up (segment -1) and words to be edited in a segment, under what the edits keep.

    A word of m letters is looked up for edits of words of m - 1, m and m + 1 letters. Keys with over
    CROWD words to be looked up are split by these words' hashes, and the words to be edited meet each part.
    """
    m = F.length("word")

    def kept(length, segment: int):
        """The letters before and after the segment in any neighbour of a word of this length, as a number."""
        first = F.floor(length * segment / SEGMENTS).cast("int")
        after = length - F.floor(length * (segment + 1) / SEGMENTS).cast("int")
        return F.xxhash64(length, F.lit(segment), F.substring("word", F.lit(1), first), F.substring("word", m - after + 1, after))

    looked = [F.struct(kept(m + d, s).alias("key"), F.lit(-1).alias("segment")) for s in range(SEGMENTS) for d in (-1, 0, 1)]
    edited = [F.struct(kept(m, s).alias("key"), F.lit(s).alias("segment")) for s in range(SEGMENTS)]
    rows = words.select("word", "n", F.explode(F.array(*looked, *edited)).alias("_k")).select("_k.*", "word", "n")
    crowds = stored(rows.where("segment < 0").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts")).where("parts > 1"))
    rows = rows.join(crowds, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("segment") < 0, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    return rows.select("key", "part", "parts", "segment", "word", "n").repartition(n_parts, "key", "part").sortWithinPartitions("segment")


def _prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length (a row each): hashes of their beginnings of 0 to all letters, and the powers of the places."""
    length = codes.shape[1]
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(length, _TURN)])
    sums = np.zeros((len(codes), length + 1), np.uint64)
    np.cumsum(LETTERS[codes] * powers[:length], axis=1, out=sums[:, 1:])
    return sums, powers


def hashes(codes: np.ndarray) -> np.ndarray:
    return _prefixes(codes)[0][:, -1]


def edits(codes: np.ndarray, first: int, end: int, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, row, place, change) of all distinct neighbours by edits at places first to end - 1, in blocks.

    change: -1 deletes the letter at the place, c below 256 puts c there, 256 + c inserts c before
    it; insertions at the end of a word belong to its last place. In a run of equal letters only
    the first is deleted, and nothing is inserted after its like, so no neighbour comes twice.
    """
    n, length = codes.shape
    sums, powers = _prefixes(codes)
    whole = sums[:, -1:]
    last = end + 1 if end == length else end
    wide = max(1, BLOCK // max(1, n * (2 * len(alphabet) + 1)))
    for a in range(first, last, wide):
        places = np.arange(a, min(a + wide, last))
        inner = places[places < length]
        before = np.where(places > 0, codes[:, np.maximum(places - 1, 0)], 256)
        if len(inner):
            here = codes[:, inner]
            row, at = np.nonzero(here != before[:, : len(inner)])
            place = inner[at]
            yield sums[row, place] + (whole[row, 0] - sums[row, place + 1]) * _BACK, row, place, np.full(len(row), -1)
            base = whole - LETTERS[here] * powers[inner]
            made = base[:, :, None] + LETTERS[alphabet] * powers[inner][:, None]
            row, at, letter = np.nonzero(here[:, :, None] != alphabet)
            yield made[row, at, letter], row, inner[at], alphabet[letter]
        base = sums[:, places] + (whole - sums[:, places]) * _TURN
        made = base[:, :, None] + LETTERS[alphabet] * powers[places][:, None]
        row, at, letter = np.nonzero(before[:, :, None] != alphabet)
        yield made[row, at, letter], row, places[at], alphabet[letter].astype(np.int64) + 256


def changed(word: bytes, place: int, change: int) -> bytes:
    """The neighbour that an edit makes."""
    if change < 0:
        return word[:place] + word[place + 1 :]
    if change < 256:
        return word[:place] + bytes((change,)) + word[place + 1 :]
    return word[:place] + bytes((change - 256,)) + word[place:]


class Shelf:
    """The words dealt to a task, found by hash."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        keys = np.zeros(len(words), np.uint64)
        for length, rows in by_length.items():
            wide = max(1, BLOCK // max(1, length))
            for a in range(0, len(rows), wide):
                some = rows[a : a + wide]
                keys[some] = hashes(np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), length))
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.words, self.counts = keys[self.order], words, counts
        self.shift = np.uint64(64 - max(10, (max(1, len(words)) * BITS - 1).bit_length()))
        self.met = np.zeros(1 << (64 - int(self.shift)), bool)
        self.met[keys >> self.shift] = True
        self.alphabet = np.unique(np.frombuffer(b"".join(words), np.uint8)) if words else np.zeros(0, np.uint8)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted hashes the shelf has, and the number of a word with each (a hash comes as often as it has words)."""
        at = np.flatnonzero(self.met[wanted >> self.shift])
        lo, hi = np.searchsorted(self.keys, wanted[at], "left"), np.searchsorted(self.keys, wanted[at], "right")
        many = hi - lo
        at, lo = np.repeat(at, many), np.repeat(lo, many)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        return at, self.order[lo + nth]


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, near, near_n) for edited words: how many neighbours are among the task's words, and the one of largest n, then least."""
    words: list[bytes] = []
    counts: list[np.ndarray] = []
    seen: set[bytes] = set()
    crowded: dict[tuple[int, int], set[bytes]] = {}  # what each part of a split key looks up, as its words may be here for other keys too
    shelf: Shelf | None = None
    for batch in batches:
        keys, parts_of, parts, segment, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5))
        own = [w.encode("latin-1") for w in batch.column(4).to_pylist()]
        for i in np.flatnonzero((segment < 0) & (parts > 1)).tolist():
            crowded.setdefault((keys[i], parts_of[i]), set()).add(own[i])
        for i in np.flatnonzero(segment < 0).tolist():
            if own[i] not in seen:  # the same word may be dealt for several segments
                seen.add(own[i])
                words.append(own[i])
                counts.append(n[i])
        edited = np.flatnonzero(segment >= 0)
        if not len(edited):
            continue
        if shelf is None:
            seen.clear()
            shelf = Shelf(words, np.array(counts, np.int64))
        groups: dict[tuple[int, int], list[int]] = {}
        for i in edited.tolist():
            groups.setdefault((len(own[i]), int(segment[i])), []).append(i)
        found: dict[bytes, list] = {}
        for (length, s), rows in groups.items():
            first, end = length * s // SEGMENTS, length * (s + 1) // SEGMENTS
            wide = max(1, BLOCK // max(1, length * 8, (end - first + 1) * (2 * len(shelf.alphabet) + 1)))
            for a in range(0, len(rows), wide):
                some = rows[a : a + wide]
                codes = np.frombuffer(b"".join(own[i] for i in some), np.uint8).reshape(len(some), length)
                for made, row, place, change in edits(codes, first, end, shelf.alphabet):
                    at, hit = shelf.find(made)
                    for r, p, c, w in zip(row[at].tolist(), place[at].tolist(), change[at].tolist(), hit.tolist(), strict=True):
                        i, near = some[r], words[w]
                        word = own[i]
                        if changed(word, p, c) != near or parts[i] > 1 and near not in crowded.get((keys[i], parts_of[i]), ()):
                            continue
                        best = found.setdefault(word, [0, None, 0])
                        best[0] += 1
                        if best[1] is None or (-counts[w], near) < (-best[2], best[1]):
                            best[1:] = near, int(counts[w])
        if found:
            some = list(found.values())
            columns = [[w.decode("latin-1") for w in found], [x[0] for x in some], [x[1].decode("latin-1") for x in some], [x[2] for x in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "near", "near_n"])
    give_back()


def near_words(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n) of a vocabulary (word, n) of distinct words over code points below 256.

    n_near counts the other words one edit apart. form is the one of largest n, of equal ones the
    first by code points, if its n is at least ``ratio`` times the word's; else null.
    """
    n_parts = max(partitions(words.sparkSession), 1)
    found = dealt(words, n_parts).mapInArrow(_matched, "word string, n_near long, near string, near_n long")
    none = F.lit(None)
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("string").alias("near"), none.cast("long").alias("near_n"))
    both = own.unionByName(found.withColumn("n", none.cast("long")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))))
    by_word = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best"))
    far = -F.col("_best.n") >= F.col("n") * ratio
    return by_word.select("word", "n", "n_near", F.when(far, F.col("_best.near")).alias("form"), F.when(far, -F.col("_best.n")).alias("form_n"))


def rooted(forms: DataFrame, *, ratio: int = 10) -> DataFrame:
    """forms with ``root``, the end of the way from a word over forms; the word itself if it has none.

    Each step multiplies n by ``ratio`` at least, so the largest n bounds the ways' length, and
    rounds that double the steps taken are few.
    """
    ways = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("n")).first()[0] or 1
    steps, rounds = 0, 0
    while ratio ** (steps + 1) <= most:
        steps += 1
    while (1 << rounds) < steps:
        rounds += 1
    for _ in range(rounds):
        ways = stored(ways)
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        ways = ways.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"))
    return forms.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 7, often: int = 2, ratio: int = 10, drop: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of whole texts; see ``vocabulary``, ``near_words`` and ``rooted``.

    Repeated rows count as often as they come; no words, no rows.
    """
    words = stored(vocabulary(docs, key=key, text=text, least=least, often=often, drop=drop))
    return rooted(stored(near_words(words, ratio=ratio)), ratio=ratio).select("word", "form", "root", "n", "n_near", "form_n")
