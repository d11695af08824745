import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import prose
from tidemill.llm import chunk_dedup, repeats, set_join, simhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(t):
    return (t or "").translate(LOWER)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact_groups_against_brute_force(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[lower(r.text)].append(r.doc_id)
    want = Counter()
    for body, keys in groups.items():
        known = [k for k in keys if k is not None]
        for k in keys:
            want[k, max(known) if known else None, len(keys), hashlib.sha256(body.encode()).hexdigest()] += 1
    got = rows(chunk_dedup.exact_groups(docs))
    assert Counter((g[0], g[1], g[2], g[4]) for g in got) == want
    assert Counter(g[4] for g in got if g[3]) == Counter(hashlib.sha256(b.encode()).hexdigest() for b in groups)


def test_exact_drop_keeps_one_row_of_each_text(docs, empty):
    kept = chunk_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and Counter(lower(r.text) for r in kept.collect()) == Counter({lower(r.text): 1 for r in docs.collect()})
    assert chunk_dedup.drop_copies(empty).count() == 0 and chunk_dedup.exact_groups(empty).count() == 0


def test_chunks_are_cut_by_content():
    data = prose(9, 40_000).encode()
    a, b = data, b"some words before " + data
    cuts = lambda x: chunk_dedup.cut(x, chunk_dedup.candidate_cuts(np.frombuffer(x, np.uint8)))
    assert b"".join(a[s:e] for s, e in cuts(a)) == a and all(0 < e - s <= chunk_dedup.MOST for s, e in cuts(a))
    one, two = {a[s:e] for s, e in cuts(a)}, {b[s:e] for s, e in cuts(b)}
    assert len(one & two) > 0.8 * len(one)


def test_identifiers_that_two_chunks_share_are_found_and_replaced(docs):
    weak = {"weak": lambda b: bytes([len(b) % 2]), "sha256": chunk_dedup.IDENTIFIERS["sha256"]}
    got = chunk_dedup.verified_recipes(docs, identifiers=weak).select("recipe").distinct().count()
    assert got == len({lower(r.text) for r in docs.collect()})
    with pytest.raises(ValueError):
        chunk_dedup.verified_recipes(docs, identifiers={"weak": weak["weak"]})


def test_repeated_bytes_against_brute_force(spark, docs, empty):
    some = docs.where("text IS NULL OR length(text) < 20000 OR doc_id % 2 = 0")
    own = [(r.doc_id, r.text or "") for r in some.collect()]
    first = {}
    for k, t in own:
        b = t.encode()
        for i in range(len(b) - 49):
            if k is not None:
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], k), k)
    want = []
    for k, t in own:
        b = t.encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - 49):
            if k is not None and first[b[i : i + 50]] < k:
                gone[i : i + 50] = 1
        kept = bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])
        want.append((k, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert Counter(rows(repeats.without_repeats(some))) == Counter(want)
    assert any(w[2] for w in want) and repeats.without_repeats(empty).count() == 0


def test_repeated_bytes_of_tables_without_statistics(spark):
    """Rows made in memory, the result of a join whose size is only guessed, and a checkpoint."""
    body = prose("shared", 60)
    made = spark.createDataFrame([(i, f"{prose(i, 20)} {body} {prose(-i, 9)}") for i in range(12)], "doc_id long, text string")
    want = Counter(rows(repeats.without_repeats(made.repartition(3).cache())))
    assert sum(w[2] > 300 for w in want) == 11
    joined = made.join(spark.range(12).withColumnRenamed("id", "doc_id"), "doc_id").join(spark.range(5), made.doc_id >= 0, "left_semi")
    for some in (made, joined, made.checkpoint()):
        assert Counter(rows(repeats.without_repeats(some))) == want


def test_bucket_pointers_name_equal_strings():
    data = np.random.default_rng(0).integers(97, 99, 3000).astype(np.uint8)
    ends = np.array([40, 90, 1000, 1000 + 50, 3000])
    pointer = repeats.refined(data, ends, 50)
    names = defaultdict(set)
    for i in range(3000):
        end = ends[np.searchsorted(ends, i, "right")]
        if i + 50 <= end:
            names[pointer[i]].add(data[i : i + 50].tobytes())
        else:
            assert pointer[i] == -1
    assert all(len(x) == 1 for x in names.values()) and len(set().union(*names.values())) == len(names)


def test_every_window_is_in_one_run():
    data = np.frombuffer((prose(5, 3000) + "a" * 500).encode(), np.uint8)
    ends = np.array([30, 79, 129, 5000, len(data)])
    start, count, anchor, _, _ = repeats.runs(data, ends)
    got = sorted(x for s, c in zip(start, count) for x in range(s, s + c))
    assert got == [i for i in range(len(data)) if i + 50 <= ends[np.searchsorted(ends, i, "right")]]
    assert ((anchor >= start + count - 1) & (anchor + repeats.GRAM <= start + 50)).all()


def brute_fingerprint(t, size=3):
    words = lower(t).translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_against_brute_force(docs, empty):
    own = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 20000]
    fps = [brute_fingerprint(t) for _, t in own]
    group = list(range(len(own)))
    for _ in own:
        for i in range(len(own)):
            for j in range(len(own)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    group[i] = min(group[i], group[j])
    least = {g: min((k for (k, _), x in zip(own, group) if x == g and k is not None), default=None) for g in group}
    want = Counter((k, f - (f >> 63 << 64), least[g]) for (k, _), f, g in zip(own, fps, group))
    assert Counter(rows(simhash.near_groups(docs.where("text IS NULL OR length(text) < 20000")))) == want
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("k", [0, 1, 3, 6])
def test_thresholds_lose_no_link(k):
    r = np.random.default_rng(k)
    fps = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    for rows_ in (10, 10**5, 10**9):
        parts = simhash.plan(fps, rows_, k)
        assert sum(t + 1 for _, t in parts) == k + 1 and len({b for bits, _ in parts for b in bits}) == sum(len(bits) for bits, _ in parts)
        for _ in range(200):
            flip = sum(1 << int(b) for b in r.choice(64, k, replace=False))
            assert any(sum(flip >> b & 1 for b in bits) <= t for bits, t in parts)


def test_links_span_the_components():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in range(64)]]))
    for some in (fps[:500], fps):
        pairs = simhash.linked(some, 3)
        assert all((int(some[a]) ^ int(some[b])).bit_count() <= 3 for a, b in pairs)
        forest = simhash.Forest()
        for a, b in pairs:
            forest.link(int(some[a]), int(some[b]))
        assert len({forest.top(int(x)) for x in fps}) == 20 or len(some) < len(fps)


def test_components_of_a_chain_and_a_star(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)], "a long, b long")
    got = dict(rows(simhash.components(links)))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_few_links_are_joined_in_few_jobs_as_the_rounds_join_them(spark):
    r = np.random.default_rng(8)
    pairs = [*r.integers(-400, 400, (500, 2)).tolist(), *([i, i + 1] for i in range(1000, 1200)), *([-9000, i] for i in range(5000, 5300))]
    links, forest = spark.createDataFrame(pairs, "a long, b long"), simhash.Forest()
    for a, b in pairs:
        if a != b:
            forest.link(a, b)
    sc, got, jobs = spark.sparkContext, [], []
    for name, most in (("alone", {}), ("rounds", {"alone": 0})):
        sc.setJobGroup(f"components-{name}", name)
        try:
            got.append(sorted(rows(simhash.components(links, **most))))
            jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"components-{name}")))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == got[1] == sorted((x, forest.top(x)) for x in list(forest.above))
    assert jobs[0] <= 10 < 20 < jobs[1]
    assert simhash.components(links.where("false")).count() == 0


def test_near_copies_keep_one_of_each_group(spark, docs, empty):
    words = prose("near", 300).split()
    own = [(1, " ".join(words)), (2, " ".join([*words[:100], "other", *words[101:]])), (3, " ".join([*words[:290], "end"])), (4, prose("far", 300)), (5, " ".join(words[:150])), (6, None), (7, "  "), (8, "a b"), (9, "A B")]
    got = {r.doc_id: r for r in simhash.near_copies(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert {k for k, r in got.items() if r.kept} == {1, 4, 5, 6, 8} and got[2].component == got[3].component == 1
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and simhash.drop_near_copies(empty).count() == 0


def test_near_copies_lose_no_pair_of_the_threshold_or_more(spark):
    own, want = [], {}
    for i in range(240):
        words = [f"w{i}x{j}" for j in range(104 if i % 2 else 304)]
        n, cut = len(words) - 4, (0.80, 0.82, 0.85, 0.9)[i // 2 % 4]
        lost = int((1 - cut) / (1 + cut) * n)  # last words changed: n - lost of n + lost shingles are shared
        own += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: len(words) - lost] + [f"v{i}x{j}" for j in range(lost)]))]
        want[i] = (n - lost) / (n + lost)
        assert want[i] >= 0.8
    own.append((480, " ".join([f"w0x{j}" for j in range(100)] + ["u"] * 300)))  # well under the threshold
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(240)} | {480}


def _groups(spark, sets, least=0.8, first=()):
    """similar_groups over sets of hashes by id, against components of all pairs."""
    rows_ = [(i, bytearray(s.tobytes())) for i, s in sets.items()]
    data = spark.createDataFrame(rows_, "id long, hashes binary").repartition(3).cache()
    own = lambda batches: ((i, np.frombuffer(h, np.uint64)) for b in batches for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    classes = spark.createDataFrame([(i, len(s), bytearray(set_join.parity(s))) for i, s in sets.items()], "id long, size long, bits binary")
    entries = set_join.listed(data.union(data.limit(5)), own, classes, least)
    got = dict(rows(set_join.similar_groups(entries, spark.createDataFrame(list(first), "a long, b long"), lambda asked: data, simhash.components, least)))
    group, held = {i: i for i in sets}, {i: set(s.tolist()) for i, s in sets.items()}
    links = [(i, j) for i in sets for j in sets if i < j and len(held[i] & held[j]) / len(held[i] | held[j]) >= least]
    for _ in sets:
        was = dict(group)
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
        if was == group:
            break
    return got, {i: g for i, g in group.items() if any(i in p for p in links)}, entries


def test_similar_sets_are_found_whatever_their_elements(spark):
    """Chains, dense groups around the threshold, sets of one element, and elements that all share."""
    r = np.random.default_rng(8)
    sets = {}
    for c in range(20):
        pool = r.integers(1, 1 << 63, 400, dtype=np.uint64)
        for i in range(3):
            sets[3 * c + i] = np.unique(pool[i * 20 : i * 20 + 200])
    pool, common = r.integers(1, 1 << 63, 120, dtype=np.uint64), r.integers(1, 1 << 63, 15, dtype=np.uint64)
    for i in range(150):
        kept = pool[r.random(120) > (0.1 if i % 2 else 0.2)]
        sets[100 + i] = np.unique(np.r_[kept, r.integers(1, 1 << 63, i % 13, dtype=np.uint64)])
    for i in range(60):
        sets[300 + i] = np.unique(np.r_[common[: 5 + i % 10], r.integers(1, 1 << 63, i % 4, dtype=np.uint64)])
    sets[400], sets[401] = common[:1], common[1:2]
    got, want, entries = _groups(spark, sets, first=[(0, 2), (100, 101)])
    assert got == want and len(set(want.values())) > 5
    assert entries.count() < sum(map(len, sets.values())) / 3


def test_long_lists_are_dealt_in_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 8)
    r = np.random.default_rng(9)
    pool, sets = r.integers(1, 1 << 63, 60, dtype=np.uint64), {}
    for i in range(120):
        sets[i] = np.unique(np.r_[pool[: 40 + i % 20], r.integers(1, 1 << 63, 2 + 3 * (i % 5), dtype=np.uint64)])
    got, want, _ = _groups(spark, sets)
    assert got == want and want
