"""Groups of similar sets: a complete search for pairs of a Jaccard similarity, without lists of all pairs.

Sets are sorted by how many sets hold an element, rarest first. Two sets that reach the
similarity ``least`` share an element among the first ``size - ceil(least * size) + 1`` of
either (prefix filter), so a set is listed under these elements only, and under none if
enough of its elements are its own. Listed sets are compared by their sizes, by the places
of the shared element, and by the parity of their elements in 512 bins, which bounds the
symmetric difference from below. None of these filters loses a pair.

What they let through is verified on the whole sets, but not pair by pair: first each set
meets two of its candidates in other components, drawn by hash, which joins most of a dense
group; then all that are still in different components are verified. Long lists are dealt in
blocks to many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import partitions, release, settle, stored

#: Elements that a task sorts at once before it deals them out, and of a partition of elements.
CHUNK, PART = 1 << 20, 4 << 20
#: Bins of the parity of a set's elements.
PARITY = 512
#: Sets of a list that one task compares at once.
BLOCK = 1024
#: Rounds in which each set meets two candidates before all that are left are verified.
DRAWS = 2
_SLACK = 1e-9


def parity(hashes: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the hashes lies in bin i."""
    return np.packbits(np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (PARITY - 1), minlength=PARITY).astype(np.uint8) & 1).tobytes()


def _batches_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups: rows, sorted by the named columns, are cut only between groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(n).to_numpy() for n in names])
        cut = int(np.flatnonzero(np.r_[True, (own[:, 1:] != own[:, :-1]).any(axis=0)])[-1])
        if held and tuple(own[:, 0]) != last:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = tuple(own[:, -1])
    if held:
        yield pa.Table.from_batches(held)


def _each(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """One table for each value of the named column, by which the rows are sorted."""
    for some in _batches_of(batches, [name]):
        for s, n in zip(*(x.tolist() for x in _runs(some.column(name).to_numpy())), strict=True):
            yield some.slice(s, n)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _runs(*sorted_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal rows."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)])
    return starts, np.diff(np.r_[starts, n])


def listed(sets: DataFrame, own: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], classes: DataFrame, least: float) -> DataFrame:
    """(element, id, size, place, bits): the sets listed under those of their first elements that others hold too.

    sets: rows from which ``own`` makes (id, ordered distinct hashes); a set may come more than
    once. classes: id (signed), size, bits, each set once. An element is dealt by its high bits
    and told by its low 32; elements that share them count as one, which only lists more.
    """
    total = classes.agg(F.sum("size")).first()[0] or 0
    parts = max(partitions(classes.sparkSession), -(-int(total) // PART))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(some: dict[int, np.ndarray]) -> pa.RecordBatch:
            ids, counts = np.fromiter(some, np.uint64), np.fromiter(map(len, some.values()), np.int64)
            all_hashes, doc = np.concatenate([*some.values()]), np.repeat(np.arange(len(ids)), counts)
            part = ((all_hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            part, doc, low = part[order], doc[order], all_hashes.astype(np.uint32)[order]
            starts, lengths = _runs(part)
            rows = []
            for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                first, held = _runs(doc[s : s + n])
                rows.append((int(part[s]), ids[doc[s : s + n][first]].tobytes(), held.astype(np.uint32).tobytes(), low[s : s + n].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "ids", "counts", "low"])

        some, held = {}, 0
        for key, hashes in own(batches):
            if len(hashes) and key not in some:
                some[key] = hashes
                held += len(hashes)
                if held >= CHUNK:
                    yield out(some)
                    some, held = {}, 0
        if some:
            yield out(some)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Elements that several sets hold go back to these sets, with how many hold them."""
        for group in _each(batches, "part"):
            ids, counts, low = (_joined(group.column(i), t) for i, t in ((1, np.uint64), (2, np.uint32), (3, np.uint32)))
            once = np.zeros(len(ids), bool)
            once[np.unique(ids, return_index=True)[1]] = True  # a set that came from several tasks counts once
            keep = np.repeat(once, counts)
            holder, low = np.repeat(ids, counts)[keep], low[keep]
            order = np.argsort(low)
            holder, low = holder[order], low[order]
            _, lengths = _runs(low)
            often = np.repeat(lengths, lengths)
            some = often > 1
            if not some.any():
                continue
            holder, low = holder[some], low[some]
            rank = np.minimum(np.floor(np.log2(often[some]) * 8), 255).astype(np.uint8)
            slot = (holder % np.uint64(parts)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            holder, low, rank, slot = holder[order], low[order], rank[order], slot[order]
            part = group.column(0)[0].as_py()
            rows = [(int(slot[s]), part, holder[s : s + n].tobytes(), low[s : s + n].tobytes(), rank[s : s + n].tobytes()) for s, n in zip(*(x.tolist() for x in _runs(slot)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.uint32)
                bits = np.array([np.frombuffer(b, np.uint8) for b in batch.column(2).to_pylist()])
                slot = (ids % np.uint64(parts)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                ids, n, bits, slot = ids[order], n[order], bits[order], slot[order]
                rows = [(int(slot[s]), -1, ids[s : s + k].tobytes(), n[s : s + k].tobytes(), bits[s : s + k].tobytes()) for s, k in zip(*(x.tolist() for x in _runs(slot)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _each(batches, "slot"):
            part = group.column(1).to_numpy()
            of_sets, of_elements = group.filter(pa.array(part < 0)), group.filter(pa.array(part >= 0))
            if not of_elements.num_rows:
                continue
            ids, n, bits = _joined(of_sets.column(2), np.uint64), _joined(of_sets.column(3), np.uint32), _joined(of_sets.column(4), np.uint8).reshape(-1, PARITY // 8)
            order = np.argsort(ids)
            ids, n, bits = ids[order], n[order].astype(np.int64), bits[order]
            holder, low, rank = (_joined(of_elements.column(i), t) for i, t in ((2, np.uint64), (3, np.uint32), (4, np.uint8)))
            element = np.repeat(of_elements.column(1).to_numpy(), [len(b) // 8 for b in of_elements.column(2).to_pylist()]).astype(np.int64) << 32 | low.astype(np.int64)
            order = np.lexsort((element, rank, holder))
            holder, element = holder[order], element[order]
            starts, lengths = _runs(holder)
            at = np.searchsorted(ids, holder[starts])
            own_n = n[at]
            alone = own_n - lengths  # elements that no other set holds come first
            take = np.maximum(0, own_n - np.ceil(least * own_n - _SLACK).astype(np.int64) + 1 - alone)
            place = np.arange(len(holder)) - np.repeat(starts, lengths)
            some = place < np.repeat(take, lengths)
            where = np.repeat(at, lengths)[some]
            place = (place + np.repeat(alone, lengths))[some]
            for i in range(0, len(where), 1 << 16):
                w = where[i : i + (1 << 16)]
                width = PARITY // 8
                held = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer((np.arange(len(w) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(bits[w].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(element[some][i : i + (1 << 16)]), pa.array(ids[w].view(np.int64)), pa.array(n[w]), pa.array(place[i : i + (1 << 16)]), held], ["element", "id", "size", "place", "bits"])

    names, kinds = ["slot", "part", "ids", "low", "rank"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    schema = "slot int, part int, ids binary, low binary, rank binary"
    elements = sets.mapInArrow(deal, "part int, ids binary, counts binary, low binary").repartition(parts, "part").sortWithinPartitions("part")
    back = elements.mapInArrow(repeated, schema).union(classes.select("id", "size", "bits").where("size > 0").mapInArrow(sizes, schema))
    out = settle(back.repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(first, "element long, id long, size long, place long, bits binary"))
    release(classes.sparkSession)
    return out


def _mixed(seed: int, *values: np.ndarray) -> np.ndarray:
    """A hash of the rows of 64-bit values."""
    out = np.full(len(values[0]), seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for v in values:
        out = (out ^ v) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(1)


def _near(group: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of candidates in different components, by the distance of their rows.

    Rows of a group (element, own, guest) are sorted by size. In a group with guests, sets
    meet guests only.
    """
    element, own_block, guest_block, ids, n, place, root = (group.column(c).to_numpy() for c in ("element", "own_block", "guest_block", "id", "size", "place", "root"))
    bits = _joined(group.column("bits"), np.uint64).reshape(-1, PARITY // 64)
    guest = group.column("guest").to_numpy()
    starts, lengths = _runs(element, own_block, guest_block)
    end = np.repeat(starts + lengths, lengths)
    split = guest_block >= 0
    at = np.arange(len(ids))
    for off in range(1, int(lengths.max(initial=1))):
        at = at[at + off < end[at]]
        at = at[n[at] >= least * n[at + off] - _SLACK]  # those further on are larger still
        if not len(at):
            break
        x, y = at, at + off
        ok = (root[x] != root[y]) & (~split[x] | (guest[x] != guest[y]))
        x, y = x[ok], y[ok]
        need = np.ceil(least / (1 + least) * (n[x] + n[y]) - _SLACK)
        ok = np.minimum(n[x] - place[x], n[y] - place[y]) >= need
        x, y, need = x[ok], y[ok], need[ok]
        for i in range(0, len(x), 1 << 16):
            a, b = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
            ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= n[a] + n[b] - 2 * need[i : i + (1 << 16)]
            if ok.any():
                yield np.minimum(ids[a[ok]], ids[b[ok]]), np.maximum(ids[a[ok]], ids[b[ok]])


def _dealt(placed: DataFrame, whole: bool) -> DataFrame:
    """placed (with root) in blocks of at most about BLOCK sets of a list; lists within one component are left out.

    Otherwise than drawn blocks, ``whole`` ones bring together all sets of a list that are in
    different components: those outside its largest component are guests of every block.
    """
    counts = placed.groupBy("element", "root").agg(F.count(F.lit(1)).alias("c"))
    lists = counts.groupBy("element").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    # A row for each list, settled: then both sides of the join are plain exchanges, and a long list is split.
    lists = settle(lists.select("element", "n", "most", "top"))
    rows = placed.join(lists, "element").withColumn("g", F.ceil(F.col("n") / BLOCK))
    if not whole:
        return rows.withColumns({"own_block": F.pmod(F.xxhash64("id", "round"), F.col("g")), "guest_block": F.lit(-1).cast("long"), "guest": F.lit(False)})
    h = F.ceil((F.col("n") - F.col("most")) / BLOCK)
    one = F.col("g") == 1
    as_own = F.when(one, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), h - 1))
    own = rows.withColumns({"own_block": F.pmod(F.xxhash64("id"), F.col("g")), "guest": F.lit(False)}).withColumn("guest_block", F.explode(as_own))
    guests = rows.where(~one & (F.col("root") != F.col("top"))).withColumns({"guest_block": F.pmod(F.xxhash64("id", F.lit(1)), h), "guest": F.lit(True)})
    return own.unionByName(guests.withColumn("own_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))))


def candidates(placed: DataFrame, least: float, turn: int | None) -> DataFrame:
    """(a, b), a < b, in different components: for each set two that the hashes of this turn draw; all if turn is None."""
    seeds = () if turn is None else (2 * turn + 1, 2 * turn + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(some: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            rows = tuple(np.concatenate(c) for c in zip(*some, strict=True))
            if not seeds:
                return tuple(np.unique(np.stack(rows), axis=1))
            which, node, chance, other = rows
            order = np.lexsort((other, chance, node, which))
            order = order[_runs(which[order], node[order])[0]]
            return tuple(c[order] for c in rows)

        def batch_of(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in rows], ["which", "node", "chance", "other"] if seeds else ["a", "b"])

        some, n = [], 0
        for group in _batches_of(batches, ["element", "own_block", "guest_block"]):
            for a, b in _near(group, least):
                for seed in seeds:
                    chance = _mixed(seed, a.view(np.uint64), b.view(np.uint64)).view(np.int64)
                    some += [(np.full(len(a), seed), x, chance, y) for x, y in ((a, b), (b, a))]
                if not seeds:
                    some.append((a, b))
                n += len(a)
                if n > 1 << 19:
                    some, n = [best(some)], 0
                    if not seeds:  # at most that many pairs are held
                        yield batch_of(some.pop())
        if some:
            yield batch_of(best(some))

    spark = placed.sparkSession
    columns = ["element", "own_block", "guest_block", "id", "size", "place", "bits", "root", "guest"]
    rows = _dealt(placed.withColumn("round", F.lit(turn)), turn is None).select(*columns)
    # Sets of equal size come in the order of their ids, so that reruns agree.
    rows = rows.repartition(partitions(spark), "element", "own_block", "guest_block").sortWithinPartitions("element", "own_block", "guest_block", "size", "id")
    if not seeds:
        return settle(rows.mapInArrow(run, "a long, b long").distinct())
    drawn = rows.mapInArrow(run, "which long, node long, chance long, other long").groupBy("which", "node").agg(F.min(F.struct("chance", "other")).alias("drawn"))
    return settle(drawn.select(F.least("node", "drawn.other").alias("a"), F.greatest("node", "drawn.other").alias("b")).distinct())


def verified(pairs: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (own: id, hashes) have an exact Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                stays.append(both / (len(x) + len(y) - both) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(stays, pa.bool_())) for i in (0, 1)], ["a", "b"])

    left, right = (own.select(F.col("id").alias(n), F.col("hashes").alias(f"of_{n}")) for n in "ab")
    return settle(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"))


def similar_groups(entries: DataFrame, first: DataFrame, fetch: Callable[[DataFrame], DataFrame], components: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """(node, root) of the sets that links of ``least`` or more join.

    entries: what ``listed`` gives. first: pairs (a, b) to verify before others, found by
    another way. fetch: from asked (id) to (id, hashes) with those sets at least.
    """
    spark = entries.sparkSession
    none = lambda names: spark.createDataFrame([], ", ".join(f"{n} long" for n in names))
    tried, links, roots, held = none("ab"), none("ab"), none(["node", "root"]), None
    for turn in (*range(DRAWS), None):
        placed = entries.join(roots, entries["id"] == roots["node"], "left").select(*entries.columns, F.coalesce("root", "id").alias("root"))
        new = candidates(placed, least, turn)
        if turn == 0:
            new = new.union(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
        new = settle(new.join(tried, ["a", "b"], "left_anti"))
        if not new.take(1):
            continue  # none drawn, or all verified before; the last turn takes the rest
        asked = new.select("a").union(new.select("b")).distinct().withColumnRenamed("a", "id")
        asked = settle(asked if held is None else asked.join(held.select("id"), "id", "left_anti"))
        if asked.take(1):
            more = stored(fetch(asked).join(asked, "id", "left_semi").dropDuplicates(["id"]))
            held = more if held is None else held.union(more)
        made = verified(new, held, least)
        release(spark)
        tried = tried.union(new)
        if made.take(1):
            links = links.union(made)
            roots = components(links)
    return roots
