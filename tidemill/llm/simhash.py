"""Near-duplicate groups by SimHash with a generalised pigeonhole principle.

Fingerprints that differ in at most k bits are linked. The bits are grouped into parts so
that correlated bits share one, and part i gets its own threshold t_i with sum(t_i + 1) = k + 1:
two linked fingerprints agree up to t_i bits in at least one part i. Thresholds come from a
dynamic programme over the parts on estimated costs: probes that a part sends out plus
candidates that it brings back, from a bounded sample of fingerprints. Every distinct
fingerprint probes; buckets are verified by all 64 bits and give edges that span them, not
pairs; components of the edges give the groups.

Near copies of the pipeline are candidates of the same fingerprints, verified by the exact
similarity of whole sets of shingles, and completed by a search that misses no similar pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import flat, partitions, release, settle, steps, stored
from tidemill.llm.set_join import listed, parity, similar_groups

#: Fingerprints that the partitioning and the thresholds are estimated on.
SAMPLE = 2048
#: Cost of comparing a candidate in numpy, as a share of the cost of sending a probe through a shuffle.
CANDIDATE = 0.02
#: Bits of a hash that tell which texts are read again for their whole sets; texts that only share them are read too.
SLOTS = 26
_LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the space-joined shingles of ``size`` words; of the whole sequence if there are fewer words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) > size else (b" ".join(words),)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(s, seed) for s in joined), np.uint64)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Ordered distinct 64-bit hashes of the shingles of ``size`` words, mixed from the hashes of their words.

    The whole sequence is the only shingle of fewer words. Not those of ``shingle_hashes``, but
    made faster: a call for each word, and the rest in numpy.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out * np.uint64(0xD6E8FEB86659FD93))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is in over half of the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of each row as a signed 64-bit integer. Null counts as empty: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, at = flat(batch.column(1))
            data = data.tobytes()
            made = np.fromiter((fingerprint(shingle_hashes(data[a:b], size)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to parts of nearly equal width; a part grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((0, 64))
    if len(sample) > 1:
        centred = bits - bits.mean(axis=0)
        spread = np.sqrt((centred**2).sum(axis=0))
        tied = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-9)
    else:
        tied = np.zeros((64, 64))
    np.fill_diagonal(tied, 0)
    free, out = set(range(64)), []
    for i in range(parts):
        width = 64 // parts + (i < 64 % parts)
        first = max(sorted(free), key=lambda b: tied[b, sorted(free)].sum())
        part = [first]
        free.discard(first)
        while len(part) < width:
            best = max(sorted(free), key=lambda b: tied[b, part].sum())
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def thresholds(sample: np.ndarray, rows: int, parts: list[list[int]], k: int) -> tuple[float, list[int]]:
    """The least estimated cost and each part's threshold (-1: the part is not probed).

    Cost of a part at threshold t: its probes, rows * (bit flips of up to t), and its
    candidates, rows^2 / 2 times the share of pairs within t bits there. That share is the
    larger of the sample's and the one of uniform bits, which a sample is too small to show.
    """
    m, inf = len(parts), float("inf")
    i, j = np.triu_indices(min(len(sample), 512), 1)
    costs = []
    for part in parts:
        apart = np.bitwise_count((sample[i] ^ sample[j]) & mask(part)) if len(i) else np.zeros(0, np.uint8)
        row = {-1: 0.0}  # a part that is not probed
        for t in range(min(k, len(part)) + 1):
            probes = sum(comb(len(part), x) for x in range(t + 1))
            seen = float((apart <= t).mean()) if len(apart) else 0.0
            row[t] = rows * probes + CANDIDATE * rows**2 / 2 * max(seen, probes / 2.0 ** len(part))
        costs.append(row)
    # best[s]: the least cost with thresholds of the parts so far that sum to s, each counted from -1.
    need = k + 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(inf, [])] * need
    for p in range(m):
        best = [min(((best[s - t - 1][0] + c, [*best[s - t - 1][1], t]) for t, c in costs[p].items() if 0 <= s - t - 1), key=lambda x: x[0], default=(inf, [])) for s in range(need + 1)]
    return best[need]


def plan(sample: np.ndarray, rows: int, k: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, for the number of parts with the least cost."""
    found = min((thresholds(sample, rows, group_bits(sample, m), k) + (group_bits(sample, m),) for m in range(1, min(k + 1, 64) + 1)), key=lambda x: x[0])
    return [(part, t) for part, t in zip(found[2], found[1], strict=True) if t >= 0]


def linked(fps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Index pairs that span the components of ``fps`` under 'at most k differing bits'.

    Each fingerprint that is reached is compared with those not reached yet, so a dense
    group costs a few passes and no list of pairs. Small buckets are compared all at once.
    """
    if len(fps) <= 1024:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= k, 1))
        if len(a) <= 2 * len(fps):
            return list(zip(a.tolist(), b.tolist(), strict=True))
    rest, out = np.arange(len(fps)), []
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= k
            if near.any():
                reached = rest[near].tolist()
                out += [(at, x) for x in reached]
                stack += reached
                rest = rest[~near]
    return out


class Forest:
    """Components of the links that one task has met, each under its smallest fingerprint."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        above = self.above
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.above[max(a, b)] = min(a, b)

    def links(self) -> pa.RecordBatch:
        """(smallest, other) of each fingerprint: tasks agree on most of them, so few links are left to join."""
        made = [(self.top(x), x) for x in list(self.above)]
        left, right = (np.array([p[i] for p in made if p[0] != p[1]], np.uint64).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])


#: Linked fingerprints that a task holds before it passes its links on.
HELD = 1_000_000


def edges(distinct: DataFrame, parts: list[tuple[list[int], int]], k: int) -> DataFrame:
    """(a, b): links that join the components (root) of fingerprints (fp), a < b.

    Each task joins what its buckets link and passes on the joined roots only.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps, all_roots = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            for first in range(0, len(all_fps), 4096):
                fps, roots = all_fps[first : first + 4096], all_roots[first : first + 4096]
                for number, (bits, t) in enumerate(parts):
                    flips = [0] + [sum(1 << b for b in c) for n in range(1, t + 1) for c in combinations(bits, n)]
                    salt = np.uint64(xxhash.xxh64_intdigest(bytes([number])))
                    for some in range(0, len(flips), 64):
                        value = ((fps & mask(bits))[:, None] ^ np.array(flips[some : some + 64], np.uint64)[None, :]).ravel()
                        # Parts do not share buckets: the salt is in bits that the part leaves free.
                        bucket = value ^ (salt & ~mask(bits))
                        times = len(flips[some : some + 64])
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (bucket, np.repeat(fps, times), np.repeat(roots, times))], ["bucket", "fp", "root"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def found(some: list[tuple[np.ndarray, ...]]) -> None:
            bucket, fps, roots = (np.concatenate(x) for x in zip(*some, strict=True))
            starts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0])
            ends = np.r_[starts[1:], len(bucket)]
            two = starts[ends - starts == 2]
            two = two[(np.bitwise_count(fps[two] ^ fps[two + 1]) <= k) & (roots[two] != roots[two + 1])]
            for x, y in zip(roots[two].tolist(), roots[two + 1].tolist(), strict=True):
                forest.link(x, y)
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                if (roots[s:e] != roots[s]).any():
                    for x, y in linked(fps[s:e], k):
                        if roots[s + x] != roots[s + y]:
                            forest.link(int(roots[s + x]), int(roots[s + y]))

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            rows = batch.column(0).to_numpy(), *(batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # where the last, perhaps unfinished, bucket begins
            if last:
                found([*held, tuple(x[:last] for x in rows)])
                held = []
                if len(forest.above) > HELD:
                    yield forest.links()
                    forest = Forest()
            elif held and held[-1][0][-1] != rows[0][0]:
                found(held)
                held = []
            held.append(tuple(x[last:] for x in rows))
        if held:
            found(held)
        yield forest.links()

    spark = distinct.sparkSession
    sent = distinct.select("fp", "root").mapInArrow(probe, "bucket long, fp long, root long")
    dealt = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(verify, "a long, b long").distinct()


#: Links at most that one task joins by itself: 4 MB. Rounds of so few are all small files, stages and waiting.
ALONE = 1 << 18


def components(links: DataFrame, rounds: int = 60, alone: int = ALONE) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes that have links.

    Up to ``alone`` distinct links are joined by one task. More take alternating small-star and
    large-star steps: each joins a node's neighbours to the smallest one around it, until
    nothing changes. Small stars come first, as they leave few of a dense group's links. Every
    step is cut off in the shared folder.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.link(x, y)
        nodes = list(forest.above)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, [forest.top(x) for x in nodes])], ["node", "root"])

    now = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if now.count() <= alone:
        found = settle(now.coalesce(1).mapInArrow(together, "node long, root long"))
        release(links.sparkSession)
        return found
    state = None
    for _ in range(rounds):
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = now.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = settle(small)
        both = small.union(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        now = settle(large)
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(links.sparkSession)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())


def linked_fingerprints(distinct: DataFrame, k: int) -> DataFrame:
    """(node, root) for the distinct fingerprints (fp) that have links at k or fewer differing bits.

    Equal values of a part come first. They join most of a dense group, and then only links
    between different components are left to find with flipped bits.
    """
    rows = distinct.count()
    sample = np.array([r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan(sample, rows, k)
    first = components(edges(distinct.select("fp", F.col("fp").alias("root")), [(bits, 0) for bits, _ in parts], k))
    if all(t == 0 for _, t in parts):
        return first
    marked = settle(distinct.join(first, distinct["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))
    second = components(edges(marked, parts, k)).withColumnsRenamed({"node": "by", "root": "to"})
    moved = marked.join(second, marked["root"] == second["by"], "left").select(F.col("fp").alias("node"), F.coalesce("to", "root").alias("root")).where("node <> root")
    moved = settle(moved)
    return moved.union(moved.select("root", "root").distinct())


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, k: int = 3) -> DataFrame:
    """One row per row of docs: key, fp (signed), component (smallest key of the group).

    Rows that repeat, null and empty texts share a fingerprint and so a group; a null key is
    never the smallest unless a group has no other (its component is null then).
    """
    marked = settle(fingerprints(docs, key=key, text=text, size=size))
    distinct = settle(marked.groupBy("fp").agg(F.min("key").alias("least")))
    roots = linked_fingerprints(distinct, k)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = settle(named)
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(smallest, "root").select("fp", "component")
    # Many rows to one: a hot fingerprint is on the left side only, where adaptive execution splits it.
    return marked.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def marks(values: DataFrame) -> np.ndarray:
    """Bits of the last SLOTS bits of the one column's values: 8 MB at most, however many there are."""
    at = F.pmod(F.col(values.columns[0]), F.lit(1 << SLOTS))
    some = values.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros(1 << (SLOTS - 3), np.uint8)
    for r in some.toLocalIterator():
        out[r.block << 12 : (r.block + 1) << 12] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8, k: int = 3) -> DataFrame:
    """One row per row of docs: key, tag (a hash of the text), component, kept.

    Texts are linked when the Jaccard similarity of their sets of shingles of ``size`` words,
    computed on the whole sets, is ``least`` or more. Groups of fingerprints at ``k`` bits give
    the first candidates; as similar sets may differ in more bits, a complete search by rare
    shingles (``set_join``) finds all others. Of linked texts the row with the smallest key
    stays. Texts without words are one group. Keys that repeat stay or go by their texts (tag).
    """
    kind = docs.schema[key].dataType.simpleString()

    def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
        data, at = flat(column)
        data = data.tobytes()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield shingle_set(data[a:b], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            made = [(xxhash.xxh64_intdigest(h.tobytes()), len(h), fingerprint(h), parity(h)) for h in sets_of(batch.column(1))]
            ids, sizes, fps, bits = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, sizes, fps)), pa.array(bits, pa.binary())], ["key", "tag", "id", "size", "fp", "bits"])

    tagged = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag"))
    marked = stored(tagged.mapInArrow(run, f"key {kind}, tag long, id long, size long, fp long, bits binary"))
    classes = settle(marked.select("id", "size", "fp", "bits").dropDuplicates(["id"]))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in steps(batches):
            for hashes in sets_of(batch.column(0)):
                yield xxhash.xxh64_intdigest(hashes.tobytes()), hashes

    def fetch(asked: DataFrame) -> DataFrame:
        """Made again from the texts that may be asked for: all sets together are larger than the texts."""
        shared = docs.sparkSession.sparkContext.broadcast(marks(marked.select("id", "tag").join(asked, "id", "left_semi").select("tag")))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch.column(1).to_numpy() & ((1 << SLOTS) - 1)
                some = batch.filter(pa.array(((shared.value[slot >> 3] >> (slot & 7)) & 1).astype(bool)))
                for few in steps(iter([some])):
                    made = [h.tobytes() for h in sets_of(few.column(0))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh64_intdigest(m) for m in made], np.uint64).view(np.int64)), pa.array(made, pa.binary())], ["id", "hashes"])

        return tagged.select("text", "tag").mapInArrow(again, "id long, hashes binary")

    worded = classes.where("size > 0")
    close = linked_fingerprints(settle(worded.select("fp").distinct()), k)
    named = worded.join(close, worded["fp"] == close["node"], "left").select("id", F.coalesce("root", "fp").alias("root"))
    heads = named.groupBy("root").agg(F.min("id").alias("a"))
    first = named.join(heads, "root").where("a <> id").select("a", F.col("id").alias("b"))
    roots = similar_groups(listed(docs.select(F.col(text).alias("text")), elements, classes, least), first, fetch, components, least)
    best = marked.groupBy("id").agg(F.min(F.struct("key", "tag")).alias("best"))
    named = settle(best.join(roots, best["id"] == roots["node"], "left").select("id", "best", F.coalesce("root", "id").alias("root")))
    to = named.groupBy("root").agg(F.min("best").alias("to"))
    named = settle(named.join(to, "root").select("id", "to"))
    # Many rows to one: a hot set is on the left side only.
    out = marked.select("key", "tag", "id").join(named, "id")
    stays = F.col("key").eqNullSafe(F.col("to.key")) & (F.col("tag") == F.col("to.tag"))
    return out.select(F.col("key").alias(key), "tag", F.col("to.key").alias("component"), stays.alias("kept"))


def drop_near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat key and text, one."""
    marked = near_copies(docs, key=key, text=text, size=size, least=least)
    stay = settle(marked.where("kept").groupBy(F.col(key).alias("__tidemill_key"), F.col("tag").alias("__tidemill_tag")).agg(F.count(F.lit(1)).alias("__tidemill_n")))
    tag = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    out = docs.withColumn("__tidemill_own", tag).join(stay.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__tidemill_key")) & (F.col("__tidemill_own") == F.col("__tidemill_tag")))
    if stay.where("__tidemill_n > 1").take(1):
        out = out.dropDuplicates([key, "__tidemill_own"])
    return out.select(*docs.columns)
