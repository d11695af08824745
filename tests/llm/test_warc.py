import gzip
import hashlib
import io
import os
import random
from collections import Counter, defaultdict

import pytest

from tidemill.llm import warc


def sha(b):
    return hashlib.sha1(b).hexdigest()


def made(i, payload, kind="response"):
    return warc.record(id=f"urn:page:{i}", type=kind, uri=f"http://a.b/{i}", refers_to=None, payload=payload, digest=sha(payload), n_bytes=len(payload))


def by_hand(rows):
    groups = defaultdict(list)
    for key, html in rows:
        groups[html or ""].append(key)
    out = Counter()
    for key, html in rows:
        data = (html or "").encode()
        keys = [k for k in groups[html or ""] if k is not None]
        keep = max(keys, default=None) if len(data) >= 1000 else None
        again = keep is not None and key != keep
        out[key, len(data), sha(data), "revisit" if again else "response", keep if again else None] += 1
    return out


def test_pages_come_back(spark):
    long, other = "é" * 500, "x" * 1000
    rows = [(i, long) for i in range(40)] + [(100 + i, "y" * 999) for i in range(5)] + [(200, other), (201, other), (201, other), (None, other), (None, "n" * 2000), (None, "n" * 2000), (300, None), (301, ""), (302, "\x00\r\n\r\n" * 400), (303, "z" * 3_000_000), (-5, "w" * 1000), (-7, "w" * 1000)]
    pages = spark.createDataFrame([(k, f"http://e.x/{k} a\r\nb", h, 1) for k, h in rows], "page_id long, url string, html string, type int").repartition(5)
    assert Counter(tuple(r) for r in warc.archived(pages).collect()) == by_hand(rows)
    assert warc.archived(pages.where("false")).count() == 0


@pytest.mark.parametrize("split", [700, 5000, 1 << 20])
def test_ranges_own_each_record_once(spark, sf, tmp_path, split):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write_archives(warc.records_of(pages.unionByName(pages.withColumn("page_id", pages.page_id + 1000))), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), split=split)
    assert got.where("error IS NOT NULL").count() == 0 and got.count() == 2 * pages.count() == got.select("id").distinct().count()
    assert got.where("type = 'revisit'").count() == pages.where("octet_length(html) >= 1000").count()
    rows = {r.page_id: r.html.encode() for r in pages.collect()}
    whole = {r.id: r for r in got.where("type = 'response'").collect()}
    assert all(bytes(whole[f"urn:page:{k + 1000}"].payload) == v and whole[f"urn:page:{k + 1000}"].digest == sha(v) for k, v in rows.items())


def ranges(data, split):
    source = warc.Bytes(type("Handle", (), {"read_at": staticmethod(lambda n, at: data[at : at + n])}), len(data))
    return [(at, got and got["id"]) for a in range(0, len(data), split) for at, got in warc.owned(source, a, min(a + split, len(data)))]


def test_archives_are_gzip_files_and_false_magic_is_passed_over():
    r = random.Random(3)
    noise = [bytes(r.randrange(256) for _ in range(3000)) + warc.MAGIC * 3 + gzip.compress(b"not a record") for _ in range(6)]
    plain = [made(i, x) for i, x in enumerate(noise)]
    data = b"".join(warc.member(x) for x in plain)
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == b"".join(plain)
    for split in (1, 97, 1000, 1 << 20):
        assert [i for _, i in ranges(data, split)] == [f"urn:page:{i}" for i in range(6)]


def test_an_archive_inside_a_record_is_not_read_as_records(monkeypatch):
    r = random.Random(4)
    inner = b"".join(warc.member(made(f"9{i}", bytes(r.randrange(256) for _ in range(400)))) for i in range(4))
    squeeze = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    stored = squeeze.compress(made(1, bytes(r.randrange(256) for _ in range(3000)) + inner + bytes(3000))) + squeeze.flush()
    data = warc.member(made(0, b"a" * 50)) + stored + warc.member(made(2, b"b" * 50)) + warc.member(made(3, b"c" * 5000))
    assert inner in data
    for chunk, split in ((64, 2000), (1 << 18, 2000), (1 << 18, 3100), (500, 700)):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert [i for _, i in ranges(data, split) if i] == [f"urn:page:{i}" for i in range(4)]


def test_damaged_archives_have_error_rows(spark, tmp_path):
    members = [warc.member(made(i, os.urandom(600))) for i in range(12)]
    hurt = members[4][:300] + b"\xff" * 40 + members[4][340:]
    data = b"junk" + b"".join([*members[:4], hurt, *members[5:11], members[11][:-30]])
    (tmp_path / "a.warc.gz").write_bytes(data)
    for split in (250, 1000, 1 << 20):
        rows = warc.read_archives(spark, str(tmp_path), split=split).collect()
        assert sorted(r.id for r in rows if r.id) == sorted(f"urn:page:{i}" for i in range(11) if i != 4)
        assert {0} <= {r.offset for r in rows if r.error} and all((r.error is None) == (r.id is not None) for r in rows)
    assert len([r for r in rows if r.error]) == 3


def test_tasks_that_fail_leave_nothing(spark, tmp_path):
    rows = spark.range(20, numPartitions=4).selectExpr("concat('urn:page:', id) AS id", "'response' AS type", "'u' AS uri", "CAST(NULL AS string) AS refers_to", "CAST('x' AS binary) AS payload", "if(id = 17, 'no hex', sha1('x')) AS digest", "1L AS n_bytes")
    with pytest.raises(Exception, match="fromhex"):
        warc.write_archives(rows, str(tmp_path / "w"))
    assert os.listdir(tmp_path / "w") == []
    warc.write_archives(rows.where("id <> 'urn:page:17'"), str(tmp_path / "w"))
    warc.write_archives(rows.where("id = 'urn:page:3'"), str(tmp_path / "w"))
    (tmp_path / "w" / "lost.warc.gz").write_bytes(warc.member(made(99, b"")))
    assert sorted(r.id for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == sorted([f"urn:page:{i}" for i in range(20) if i != 17] + ["urn:page:3"])
