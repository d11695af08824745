import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import prose
from tidemill.llm import chunk_dedup, queries, simhash, toxicity

tokenizers = pytest.importorskip("tokenizers")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(b):
    return hashlib.sha256(b).hexdigest()


def shingles(t):
    w = t.translate(LOWER).split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(docs, model):
    """The stages on rows in memory: pairs compared one by one, words drawn by their ranks."""
    rows = [r for r, s in zip(docs, model.scores([r.text or "" for r in docs])) if s < 0.5]
    largest = {}
    for r in rows:
        body = (r.text or "").translate(LOWER)
        largest[body] = max(largest.get(body, r), r, key=lambda x: x.doc_id)
    rows = sorted(largest.values(), key=lambda r: r.doc_id)
    sets = [shingles(r.text or "") for r in rows]
    group = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in links * 4:
        group[i] = group[j] = min(group[i], group[j])
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append(r)
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = {s: sum(size[r.doc_id] for r in sources[s]) for s in order}, set()
    while True:
        share = (sum(total.values()) - 3 * sum(total[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and share * weight[s] > 3 * total[s]}
        if not above:
            break
        full |= above
    out = []
    for s in order:
        target = 3.0 * total[s] if s in full else share * weight[s]
        w = {r.doc_id: 1.5 if size[r.doc_id] >= 512 else 1.0 if size[r.doc_id] >= 64 else 0.5 for r in sources[s]}
        level = target / max(1e-9, sum(size[k] * x for k, x in w.items()))
        for _ in range(3):  # classes that stop at three copies leave more to the others
            over = [k for k, x in w.items() if level * x > 3]
            rest = sum(size[k] * w[k] for k in w if k not in over)
            level = (target - 3 * sum(size[k] for k in over)) / rest if rest else level
        e = {k: min(3.0, level * x) for k, x in w.items()}
        left, words = target - sum(int(e[k]) * size[k] for k in e), 0
        u = lambda r: (int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        odds = lambda r: (e[r.doc_id] % 1) / (1 - e[r.doc_id] % 1)
        out += [r for r in sources[s] for _ in range(int(e[r.doc_id]))]
        for r in sorted((r for r in sources[s] if e[r.doc_id] % 1 > 0), key=lambda r: (u(r) / (1 - u(r)) / odds(r), r.doc_id)):
            words += size[r.doc_id]
            out += [r] * int(words - size[r.doc_id] / 2 <= left)
    return out


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r in brute(docs.collect(), model):
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_pipeline_with_hot_groups_and_odd_rows(spark, sf, tmp_path):
    """Large groups of exact and near copies, repeated rows, null and empty texts, a null source and columns named like results."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    words, more, key = prose("hot", 120).split(), [], 10_000
    for i in range(90):
        key += 1
        cut = words[: 120 - i % 30]
        more.append((key, " ".join(words) if i % 3 == 0 else " ".join([*cut, f"own{i}"]), "en", "hot", 1))
    more += [(20_000 + i, t, "en", s, 0) for i, (t, s) in enumerate([(None, "hot"), ("", None), (" \t", "x"), ("one", None), ("One", "hot"), (prose(9, 4000), None)])]
    odd = docs.union(spark.createDataFrame([*more, *more[:5], more[-1]], docs.schema)).selectExpr("*", "1 AS kept", "'x' AS component", "2.0D AS score")
    odd.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    odd = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(odd, spark.read.parquet(f"{sf}/labels.parquet"))
    want = Counter((r.doc_id, sha((r.text or "").encode())) for r in brute(odd.collect(), model))
    assert Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_near_copies_are_those_of_exact_similarity(spark, sf):
    """All pairs of whole shingle sets at 0.8 or more are joined, and no others: recall 1."""
    docs = chunk_dedup.drop_copies(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    own = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    near = {frozenset((i, j)) for i in own for j in own if i < j and len(own[i] & own[j]) / len(own[i] | own[j]) >= 0.8}
    group = {k: k for k in own}
    for _ in own:
        for i, j in map(tuple, near):
            group[i] = group[j] = min(group[i], group[j])
    got = {r.doc_id: r.component for r in simhash.near_copies(docs).collect()}
    assert near and got == group
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {k for k in own if group[k] == k}


def test_stages_return_the_columns_of_documents(docs, empty, spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "bpe"]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in (table, table.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf)
            assert rows.columns == table.columns
            rows = rows.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, sf).count() == rows.count()


def test_queries_are_registered():
    found = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11)) and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
