import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import fim

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def by_hand(key, text, seed=1):
    """n, form, prefix_chars, middle_chars, output by the definition."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(texts, lane=None):
    data = [(t or "").encode() for t in texts]
    at = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
    made = fim._rows(np.frombuffer(b"".join(data), np.uint8), at, list(range(len(texts))), fim.automaton(), (b"<P>", b"<S>", b"<M>"), 1, 10, 20)
    return [(*r[:4], r[4].decode()) for r in zip(*made, strict=True)]


def test_outputs_and_the_way_back(spark, docs, texts, empty):
    more = [(100 + i, f"x{'<' * i}{'PSM'[i % 3]}> é<{'P' * (i % 2)}S >") for i in range(40)] + [(200 + i, f"say <{'PSM'[i % 3]}> here") for i in range(6)] + [(300 + i, t) for i, (_, t) in enumerate(texts)]
    some = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    out = fim.transform(some).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == some.count()
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(empty).count() == 0
    clash = fim.transform(docs.withColumnRenamed("label", "form").withColumnRenamed("score", "output"))
    assert clash.columns == ["doc_id", "text", "source", "input_form", "input_output", "n", "form", "prefix_chars", "middle_chars", "output"] and clash.count() == docs.count()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="<>PSMab é漢\U0001f600\n\x00", max_size=40), max_size=12))
def test_any_texts(texts):
    assert rows_of(texts) == [by_hand(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("lane", [1, 2, 3, 5, 64])
def test_lanes_of_any_width(monkeypatch, lane, texts):
    monkeypatch.setattr(fim, "LANE", lane)
    monkeypatch.setattr(fim, "LOOKED", 3)
    some = [t for _, t in texts if not t or len(t) < 4000] + ["<P", "<P>", "a<S>b", "漢<M>", "\U0001f600" * 9 + "ab"] * 3
    assert rows_of(some) == [by_hand(i, t) for i, t in enumerate(some)]


def test_sentinels_that_overlap_are_an_error():
    for bad in (("<P>", "<P>x", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.automaton(bad)
    assert fim.automaton(("<pre>", "<suf>", "<mid>")).reach == 4
