import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(rows, least=7, often=2):
    total = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(words):
    """(word, form, root, n, n_near, form_n) from all pairs."""
    forms, out = {}, {}
    for w, n in words.items():
        close = [v for v in words if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        forms[w], out[w] = form, (n, len(close), words[form] if form else None)
    rows = set()
    for w, (n, n_near, form_n) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, n_near, form_n))
    return rows


def vocab(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def near_rows(spark, words):
    got = spelling.rooted(spelling.near_words(vocab(spark, words))).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(words)
    return {tuple(r) for r in got}


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=6), st.integers(0, 2))
def test_neighbours_are_complete_and_distinct(word, segment):
    alphabet = np.frombuffer("abé".encode("latin-1"), np.uint8)
    raw = word.encode("latin-1")
    codes = np.frombuffer(raw, np.uint8)[None]
    made = [(int(h), spelling.changed(raw, p, c)) for hs, _, ps, cs in spelling.edits(codes, 0, len(raw), alphabet) for h, p, c in zip(hs, ps.tolist(), cs.tolist(), strict=True)]
    want = {raw[:i] + raw[i + 1 :] for i in range(len(raw))} | {raw[:i] + bytes((c,)) + raw[i + d :] for d in (0, 1) for i in range(len(raw) + 1 - d) for c in alphabet} - {raw}
    assert sorted(m for _, m in made) == sorted(want)
    assert all(h == int(spelling.hashes(np.frombuffer(m, np.uint8)[None])[0]) for h, m in made if m)


def test_words_counts_and_forms_of_documents(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(1000 + i, "Réunion's réunions REUNION reunion counting countings É漢tudiant éétudiant" + " reunion" * (i % 7)) for i in range(60)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.variants(some).collect()
    assert {tuple(r) for r in got} == by_hand(words_by_hand(rows)) and len(got) == len(words_by_hand(rows))
    assert spelling.variants(empty).count() == 0


def test_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.variants(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == by_hand(words_by_hand(rows))


@pytest.mark.parametrize("crowd, block", [(2, 1 << 20), (200_000, 50), (3, 64)])
def test_crowded_keys_and_small_blocks(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = {f"aaaa{x}{y}bbbb": 1 + 7 * i for i, (x, y) in enumerate((x, y) for x in "abcdeé" for y in "abc")} | {"aaaaaaa": 1000, "aaaaaaaa": 10, "aaaaaaaaa": 1, "aaaaaab": 100}
    assert near_rows(spark, words) == by_hand(words)


def test_ways_of_many_steps(spark):
    words = {"abcdefg" + "h" * i: 10 ** (9 - i) for i in range(10)} | {"zzzzzzzz": 5}
    got = near_rows(spark, words)
    assert got == by_hand(words) and {r[2] for r in got} == {"abcdefg", "zzzzzzzz"}


def test_very_long_words(spark):
    word = "ab" * 40_000
    words = {word: 50, word[:-1]: 5, "x" + word: 4, word[:30_000] + "z" + word[30_001:]: 3}
    got = {r[0]: r[1:] for r in near_rows(spark, words)}
    assert all(got[w][0] == word and got[w][3] == 1 for w in words if w != word) and got[word][3] == 3
