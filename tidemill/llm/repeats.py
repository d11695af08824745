"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
smaller id. The suffixes of the corpus are sorted by their first ``length`` bytes only, and
only those that can repeat, in three steps:

1. Initial buckets. Every window of ``length`` bytes has one anchor, the q-gram with the
   smallest hash in it (the leftmost of equals), so equal windows have equal anchors at equal
   offsets. Consecutive windows with the same anchor make a run, about one for 16 bytes. Runs
   are dealt by their anchor's bucket. Buckets of one document are done.
2. First refinement: a bucket is sorted by the identifiers of the whole runs. Runs with the
   same identifier are equal, so all of them but those of the smallest document are repeats.
   Buckets with one identifier are done. In the others the runs of each identifier's smallest
   document go on, split in two by the side on which more of the window lies, under the
   bucket identifier of the q-gram and the bytes on that side.
3. Bucket-pointer refinement of the bytes of these runs: suffixes get pointers to buckets by
   their first 8 bytes; buckets are refined by sorting on the pointers at the offset that the
   pointers reach already (8, 16, then what is missing to ``length``); refined pointers are
   the sort keys of the next round, and buckets of one suffix leave the sort.

Records travel in compressed blocks. Within a task, equal runs are one record before
anything is shuffled, so a passage that a third of all documents hold, or thousands of
copies of a document, are one record of each block of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import flat, give_back, partitions, release, steps, stored

#: Length of a string that may not repeat, and of the q-grams that are anchors.
LENGTH, GRAM = 50, 20
#: Text of one numpy step, and of the blocks that records are gathered for.
STEP, BLOCK = 1 << 20, 16 << 20
#: Bytes of text for each bucket of runs and of documents: at most, and, on small inputs, at least.
PER_BUCKET, LEAST_BUCKET = 48 << 20, 4 << 20
#: Buckets of bytes for each bucket of runs: sorting suffixes takes some 60 times their bytes.
FINER = 4

_RANDOM = np.random.default_rng(50)
_FIRST, _SECOND = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64), _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 24) - 1)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = STEP + 4096
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of the texts that ``data`` holds one after another, ``ends`` being their ends.

    Returns first window, number of windows, anchor's place, bucket (48 bits of the anchor's
    hash) and identifier (64 bits of the whole run's hash, which is another one: equal runs
    are told by 112 bits). len(data) may be STEP + 4095.
    """
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    up, down = _powers()
    first = np.zeros(n + 1, np.uint64)
    np.cumsum(_FIRST[data] * up[:n], out=first[1:])
    grams = _mix((first[gram:] - first[:-gram]) * down[: n - gram + 1])
    # The smallest hash and, among equals, the smallest place: both in one integer.
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, reached = length - gram + 1, 1
    while reached * 2 <= width:
        least = np.minimum(least[:-reached], least[reached:])
        reached *= 2
    if reached < width:
        least = np.minimum(least[: -(width - reached)], least[width - reached :])
    anchor = (least & _POSITION).astype(np.int64)
    inside = np.ones(n, bool)
    for back in range(1, length):
        at = ends - back
        inside[at[at >= 0]] = False
    # Texts shorter than that are ruled out by their own end above; longer ones keep their first windows.
    inside = inside[: len(anchor)]
    changed = np.ones(len(anchor), bool)
    changed[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(changed & inside)
    if not len(start):
        return none
    stop = np.flatnonzero(inside & np.r_[changed[1:] | ~inside[1:], True]) + 1
    second = np.zeros(n + 1, np.uint64)
    np.cumsum(_SECOND[data] * up[:n], out=second[1:])
    whole = _mix((second[stop + length - 1] - second[start]) * down[start]) ^ (stop - start).astype(np.uint64)
    bucket = _mix(grams[anchor[start]] + np.uint64(_BASE)) >> np.uint64(16)
    return start, stop - start, anchor[start], bucket, whole


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of integers byte by byte, most significant bytes last, so that zeros compress."""
    body = b"".join(np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def _columns(block: bytes, n: int) -> list[np.ndarray]:
    rows = int.from_bytes(block[:8], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[8:]), np.uint8).reshape(n, 8, rows)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in body]


def _pack(doc: np.ndarray, check: np.ndarray, *columns: np.ndarray) -> bytes:
    """Rows of (document, check) and further columns; each document is written once."""
    doc, check = doc.view(np.uint64), check.astype(np.uint64)
    order = np.lexsort((check, doc))
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (np.diff(doc[order]) != 0) | (np.diff(check[order]) != 0)
    of = np.empty(len(doc), np.int64)
    of[order] = np.cumsum(fresh) - 1
    known = order[fresh]
    own = _planes(np.diff(doc[known], prepend=np.uint64(0)), check[known])
    return len(own).to_bytes(8, "little") + own + _planes(of, *columns)


def _unpack(block: bytes, n: int) -> list[np.ndarray]:
    size = int.from_bytes(block[:8], "little")
    gaps, check = _columns(block[8 : 8 + size], 2)
    of, *columns = _columns(block[8 + size :], n + 1)
    of = of.astype(np.int64)
    return [np.cumsum(gaps, dtype=np.uint64)[of].view(np.int64), check[of], *columns]


def _merged(doc: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans by document and place, those that touch joined."""
    if not len(doc):
        return [doc, check, start, end]
    order = np.lexsort((start, check, doc))
    doc, check, start, end = doc[order], check[order], start[order].astype(np.int64), end[order].astype(np.int64)
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (check[1:] != check[:-1])]
    # Ends so far within a document: a document's number lifts its ends above those before.
    lift = np.cumsum(fresh) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    begins = fresh.copy()
    begins[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(begins)
    return [doc[at], check[at], start[at], reach[np.r_[at[1:], len(doc)] - 1]]


def _dealt(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its rows) for keys that are dealt by their value."""
    of = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [(int(of[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def _by_doc(doc: np.ndarray) -> np.ndarray:
    return _mix(doc.view(np.uint64) + np.uint64(11))


#: Kinds of blocks: texts, spans that go, runs, runs whose bytes are asked for, and runs with their bytes.
TEXT, SPANS, RUNS, ASKED, BYTES = "text", "spans", "runs", "asked", "bytes"
_BLOCKS = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.binary())])
_BLOCKS_SQL = "kind string, bucket int, block binary"


def _rows(kind: str, made: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(made), 64):
        some = made[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some)), pa.array([b for b, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], schema=_BLOCKS)


def _spans(doc: np.ndarray, check: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    spans = _merged(doc, check, start, end)
    yield from _rows(SPANS, [(b, _pack(*(c[p] for c in spans))) for b, p in _dealt(_by_doc(spans[0]), buckets)] if len(spans[0]) else [])


def _check(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text)


def _cut_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """(document, check, offset, text): pieces of at most STEP window starts, each with the bytes that its last windows need."""
    data, at = flat(batch.column(1))
    for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        if doc is None:
            continue
        text = data[a:b].tobytes()
        check = _check(text)
        for offset in range(0, max(1, b - a), STEP):
            yield doc, check, offset, text[offset : offset + STEP + LENGTH - 1]


def gather_runs(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Blocks of runs by bucket, and of the spans that repeat within one block of text."""

    def flush(pieces: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        found = []
        i = 0
        while i < len(pieces):
            j, size = i, 0
            while j < len(pieces) and (j == i or size + len(pieces[j][3]) <= STEP):
                size += len(pieces[j][3])
                j += 1
            lengths = np.array([len(p[3]) for p in pieces[i:j]])
            ends = np.cumsum(lengths)
            start, count, anchor, bucket, whole = runs(np.frombuffer(b"".join(p[3] for p in pieces[i:j]), np.uint8), ends, length, gram)
            of = np.searchsorted(ends, start, "right")
            place = start - (ends - lengths)[of] + np.array([p[2] for p in pieces[i:j]], np.int64)[of]
            found.append((np.array([p[0] for p in pieces[i:j]], np.int64)[of], np.array([p[1] for p in pieces[i:j]], np.uint64)[of], place, count | (anchor - start) << 16, bucket, whole))
            i = j
        doc, check, place, shape, bucket, whole = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        if not len(doc):
            return
        # Equal runs come together; a bucket and the first bits of an identifier are one sort key.
        order = np.argsort(bucket << np.uint64(16) | whole >> np.uint64(48))
        doc, check, place, shape, bucket, whole = (x[order] for x in (doc, check, place, shape, bucket, whole))
        heads = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (whole[1:] != whole[:-1])])
        least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.r_[heads, len(doc)]))
        again = doc > least
        yield from _spans(doc[again], check[again], place[again], place[again] + (shape[again] & 0xFFFF) + length - 1, buckets)
        stay = ~again
        doc, check, place, shape, bucket, whole = (x[stay] for x in (doc, check, place, shape, bucket, whole))
        made = []
        for b, p in _dealt(bucket, buckets):
            made.append((b, _pack(doc[p], check[p], np.diff(bucket[p], prepend=np.uint64(0)), whole[p], place[p], shape[p])))
        yield from _rows(RUNS, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in steps(batches):
            for piece in _cut_texts(batch):
                pieces.append(piece)
                size += len(piece[3])
                if size >= BLOCK:
                    yield from flush(pieces)
                    pieces, size = [], 0
                    give_back()
        if pieces:
            yield from flush(pieces)
        give_back()

    return docs.mapInArrow(run, _BLOCKS_SQL)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, Iterator[bytes]]]:
    """(bucket, kind, blocks) of rows that come sorted by bucket and kind. Blocks must be read before the next group."""

    def rows() -> Iterator[tuple[tuple[int, str], bytes]]:
        for batch in batches:
            kinds, numbers, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, key in enumerate(zip(numbers, kinds, strict=True)):
                yield key, blocks[i].as_py()

    source = rows()
    held = next(source, None)
    while held is not None:
        key = held[0]

        def group() -> Iterator[bytes]:
            nonlocal held
            while held is not None and held[0] == key:
                block = held[1]
                held = next(source, None)
                yield block

        blocks = group()
        yield *key, blocks
        for _ in blocks:
            pass
        give_back()


def refine_by_runs(blocks: DataFrame, buckets: int, length: int) -> DataFrame:
    """Spans that repeat as whole runs, and the runs whose bytes decide (ASKED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, kind, group in _by_bucket(batches):
            if kind == SPANS:
                for block in group:
                    yield from _rows(SPANS, [(at, block)])
                continue
            parts = []
            for block in group:
                doc, check, gaps, whole, place, shape = _unpack(block, 4)
                parts.append((doc, check, np.cumsum(gaps, dtype=np.uint64), whole, place, shape))
            doc, check, bucket, whole, place, shape = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            # Identifiers that share their first bits may come mixed; their runs are then decided by their bytes.
            order = np.argsort(bucket << np.uint64(16) | whole >> np.uint64(48))
            doc, check, bucket, whole, place, shape = (x[order] for x in (doc, check, bucket, whole, place, shape))
            fresh = np.r_[True, bucket[1:] != bucket[:-1]]
            heads = np.flatnonzero(fresh)
            sizes = np.diff(np.r_[heads, len(doc)])
            many = np.repeat(np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads), sizes)
            kinds = np.flatnonzero(fresh | np.r_[True, whole[1:] != whole[:-1]])
            least = np.repeat(np.minimum.reduceat(doc, kinds), np.diff(np.r_[kinds, len(doc)]))
            again = doc > least
            yield from _spans(doc[again], check[again], place[again], place[again] + (shape[again] & np.uint64(0xFFFF)) + np.uint64(length - 1), buckets)
            several = np.repeat(np.diff(np.searchsorted(kinds, np.r_[heads, len(doc)])) > 1, sizes)
            ask = many & several & ~again
            if ask.any():
                doc, check, place, shape = doc[ask], check[ask], place[ask], shape[ask]
                yield from _rows(ASKED, [(b, _pack(doc[p], check[p], place[p], shape[p])) for b, p in _dealt(_by_doc(doc), buckets)])

    return blocks.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(run, _BLOCKS_SQL)


def text_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Whole texts in compressed blocks, dealt by document."""

    def flush(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        made = []
        for b, p in _dealt(_by_doc(np.array([d for d, _ in rows], np.int64)), buckets):
            some = [rows[i] for i in p.tolist()]
            head = np.array([x for d, t in some for x in (d, len(t))], np.int64).tobytes()
            made.append((b, len(some).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(head + b"".join(t for _, t in some))))
        yield from _rows(TEXT, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in steps(batches):
            data, at = flat(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if doc is not None:
                    rows.append((doc, data[a:b].tobytes()))
                    size += b - a
                if size >= BLOCK:
                    yield from flush(rows)
                    rows, size = [], 0
        if rows:
            yield from flush(rows)
        give_back()

    return docs.mapInArrow(run, _BLOCKS_SQL)


def _texts(block: bytes) -> Iterator[tuple[int, bytes]]:
    n = int.from_bytes(block[:8], "little")
    body = zstandard.ZstdDecompressor().decompress(block[8:])
    head = np.frombuffer(body[: 16 * n], np.int64).reshape(n, 2)
    at = 16 * n
    for doc, size in head.tolist():
        yield doc, body[at : at + size]
        at += size


class _Lookup:
    """Rows of (document, check, ...) to be found by document."""

    def __init__(self, blocks: Iterator[bytes], n: int):
        parts = [_unpack(b, n) for b in blocks]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * (n + 2)
        order = np.lexsort((columns[2], columns[1], columns[0]))
        self.columns = [c[order] for c in columns]

    def of(self, doc: int, text: bytes) -> list[np.ndarray]:
        a, b = np.searchsorted(self.columns[0], [doc, doc], "left")[0], np.searchsorted(self.columns[0], doc, "right")
        if a == b:
            return [c[:0] for c in self.columns[2:]]
        check = self.columns[1][a:b] == _check(text)
        return [c[a:b][check].astype(np.int64) for c in self.columns[2:]]


def fetch_bytes(blocks: DataFrame, buckets: int, to: int, length: int, gram: int) -> DataFrame:
    """The bytes of the runs that are asked for, dealt by the bucket of the q-gram and the bytes beside it.

    Of a window with the anchor at offset d, d bytes lie on its left and length - gram - d on
    its right; one side has at least half of them. A run is split there in two.
    """
    half = (length - gram) // 2

    def flush(made: dict[int, list[tuple[int, int, int, bytes]]]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows in made.items():
            size = np.array([len(r[3]) for r in rows], np.uint64)
            head = _pack(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows], np.uint64), size)
            # The rows of _pack keep their order, so the bytes follow in it.
            out.append((key, len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=1).compress(b"".join(r[3] for r in rows))))
        yield from _rows(BYTES, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: tuple[int, _Lookup] | None = None
        made: dict[int, list[tuple[int, int, int, bytes]]] = {}
        held = 0
        for at, kind, group in _by_bucket(batches):
            if kind == ASKED:
                asked = at, _Lookup(group, 2)
                continue
            if kind != TEXT or asked is None or asked[0] != at:
                continue
            for block in group:
                for doc, text in _texts(block):
                    places, shapes = asked[1].of(doc, text)
                    if not len(places):
                        continue
                    check = _check(text)
                    for place, count, anchor in zip(places.tolist(), (shapes & 0xFFFF).tolist(), (shapes >> 16).tolist(), strict=True):
                        body = text[place : place + count + length - 1]
                        # Windows that start up to here have the anchor's right side as the smaller one.
                        left = min(count, max(0, anchor - half + 1))
                        for first, windows, side in ((0, left, body[anchor - half : anchor + gram]), (left, count - left, body[anchor : anchor + gram + half])):
                            if windows > 0:
                                key = xxhash.xxh64_intdigest(side, seed=len(side)) % to
                                made.setdefault(key, []).append((doc, check, place + first, body[first : first + windows + length - 1]))
                                held += windows + length - 1
                    if held > BLOCK // 2:
                        yield from flush(made)
                        made, held = {}, 0
        if made:
            yield from flush(made)

    return blocks.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(run, _BLOCKS_SQL)


def refined(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """A bucket pointer for each place of data: equal for places with equal strings of ``length`` bytes.

    Places nearer than that to the end of their text (``ends``) point nowhere: -1.
    """
    n = len(data)
    room = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)
    depth = min(8, length)
    word = np.zeros(n, np.uint64)
    for i in range(depth):
        word[: n - i] |= data[i:].astype(np.uint64) << np.uint64(8 * (7 - i))
    pointer = np.full(n, -1, np.int64)
    # The suffixes in sorted order; a suffix points to the slot at which its bucket begins.
    order = np.flatnonzero(room >= depth)
    order = order[np.argsort(word[order])]
    slots = np.arange(len(order))
    begins = np.r_[True, np.diff(word[order]) != 0] if len(order) else np.zeros(0, bool)
    pointer[order] = np.maximum.accumulate(np.where(begins, slots, 0))
    while depth < length:
        offset = min(depth, length - depth)
        # Buckets of one leave the sort, and so do suffixes that are too short; their pointers stay for others.
        alone = begins & np.r_[begins[1:], True]
        stay = ~alone & (room[order] >= depth + offset)
        order, slots = order[stay], slots[stay]
        if not len(order):
            break
        head, later = pointer[order], pointer[order + offset]
        by = np.argsort(head << 32 | later)
        order, head, later = order[by], head[by], later[by]
        begins = np.r_[True, (np.diff(head) != 0) | (np.diff(later) != 0)]
        pointer[order] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        depth += offset
    pointer[room < length] = -1
    return pointer


def refine_bytes(blocks: DataFrame, of: int, buckets: int, length: int) -> DataFrame:
    """Spans that repeat among runs that are equal in part; of: the number of buckets that the bytes are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, group in _by_bucket(batches):
            heads, bodies = [], []
            for block in group:
                size = int.from_bytes(block[:8], "little")
                heads.append(_unpack(block[8 : 8 + size], 2))
                bodies.append(zstandard.ZstdDecompressor().decompress(block[8 + size :]))
            doc, check, place, size = (np.concatenate(x) for x in zip(*heads, strict=True))
            size = size.astype(np.int64)
            ends = np.cumsum(size)
            pointer = refined(np.frombuffer(b"".join(bodies), np.uint8), ends, length)
            at = np.flatnonzero(pointer >= 0)
            row = np.repeat(np.arange(len(size)), size)[at]
            order = np.argsort(pointer[at])
            at, row = at[order], row[order]
            begins = np.flatnonzero(np.r_[True, np.diff(pointer[at]) != 0])
            least = np.repeat(np.minimum.reduceat(doc[row], begins), np.diff(np.r_[begins, len(at)]))
            again = doc[row] > least
            at, row = at[again], row[again]
            start = place[row].astype(np.int64) + at - (ends - size)[row]
            yield from _spans(doc[row], check[row], start, start + length, buckets)

    return blocks.repartitionById(of, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(run, _BLOCKS_SQL)


def _kept(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the number of maximal runs of removed bytes."""
    zero = np.zeros(len(start), np.int64)
    _, _, start, end = _merged(zero, zero, start, end)
    view, parts, at = memoryview(text), [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        parts.append(view[at:a])
        at = b
    parts.append(view[at:])
    return b"".join(parts), int((end - start).sum()), len(start)


def apply_spans(blocks: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text without its spans, as UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        spans: tuple[int, _Lookup] | None = None
        for at, kind, group in _by_bucket(batches):
            if kind == SPANS:
                spans = at, _Lookup(group, 2)
                continue
            for block in group:
                rows = []
                for doc, text in _texts(block):
                    if spans is not None and spans[0] == at:
                        kept, removed, n = _kept(text, *spans[1].of(doc, text))
                    else:
                        kept, removed, n = text, 0, 0
                    rows.append((doc, len(text), removed, n, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names)

    return blocks.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    The key is an integer. Null texts count as empty; texts shorter than ``length`` stay
    whole. Rows with a null key remove nothing and lose nothing. Rows that repeat a key are
    one document: none of its strings removes another of them.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Spark numbers partitions in 31 bits, and there are FINER times as many buckets of bytes.
    buckets = min(max(1, min(partitions(spark), size // LEAST_BUCKET), -(-size // PER_BUCKET)), ((1 << 31) - 1) // FINER)
    first = stored(refine_by_runs(gather_runs(docs, buckets, length, gram), buckets, length))
    release(spark)
    asked = first.where(F.col("kind") == ASKED).union(text_blocks(docs, buckets))
    second = stored(refine_bytes(fetch_bytes(asked, buckets, FINER * buckets, length, gram), FINER * buckets, buckets, length))
    release(spark)
    spans = first.where(F.col("kind") == SPANS).union(second)
    out = apply_spans(spans.union(text_blocks(docs, buckets)), buckets)
    plain = docs.where("doc_id IS NULL")
    body = F.coalesce("text", F.lit(""))
    return out.union(plain.select("doc_id", F.octet_length(body).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(body, 256)))
