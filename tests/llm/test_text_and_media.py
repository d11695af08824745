import hashlib
import importlib
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tidemill.llm import bpe, chat, queries, tiff

tokenizers = pytest.importorskip("tokenizers")


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(queries.tokenizer_path(), encoding="utf-8").read())


def test_bpe_equals_the_library(docs, empty, library):
    more = docs.sparkSession.createDataFrame([(50, "a<|endoftext|>b  <|endoftext|>"), (51, "it's we'll  \n\n x\t 12² ⅔ ٣ " + "ab" * 700), (52, "e\u0301 \u200d\u2028 \ufeff")], "doc_id long, text string")
    some = docs.select("doc_id", "text").union(more)
    want = Counter()
    for r in some.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode())] += 1
    assert Counter(tuple(r) for r in bpe.encode_column(some, queries.tokenizer_path(), digests=True).collect()) == want
    clash = bpe.encode_column(docs.withColumnRenamed("score", "ids"), queries.tokenizer_path())
    assert clash.columns == ["doc_id", "text", "source", "label", "input_ids", "ids", "decoded"] and clash.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.encode_column(empty, queries.tokenizer_path(), digests=True).count() == 0


def test_bpe_of_long_words(vocabulary, library):
    """Words of 60,000 letters: mixed, of few syllables, of one letter."""
    r = np.random.default_rng(12)
    letters = np.array(list("etaoinshrdlu"))
    for word in ("".join(r.choice(letters, 60_000)), "".join(r.choice(["tion", "an", "e", "str"], 20_000)), "a" * 60_001):
        began = time.perf_counter()
        made = bpe.merged([word.encode(), b"word", b"ab"], vocabulary)
        assert time.perf_counter() - began < 20
        assert made[0].tolist() == library.encode(word, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(text):
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path()) if not hasattr(test_bpe_of_any_text, "own") else test_bpe_of_any_text.own[0]
    if not hasattr(test_bpe_of_any_text, "own"):
        test_bpe_of_any_text.own = library, bpe.Encoder(bpe.Vocabulary(open(queries.tokenizer_path(), encoding="utf-8").read()))
    encoder = test_bpe_of_any_text.own[1]
    ids = encoder.encode([text])[0]
    assert encoder.decode(ids) == text
    if text.isascii():
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_beyond_the_table_are_encoded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 5)
    encoder = bpe.Encoder(vocabulary)
    for i in range(3):
        t = prose(i, 50)
        assert encoder.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids and len(encoder.held) <= 5


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [tiff.NO_PREDICTOR, tiff.HORIZONTAL])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(scheme, predictor, tile, order):
    r = np.random.default_rng(1)
    images = [r.integers(0, 4, (37, 53, 3)).astype(np.uint8), r.integers(0, 60000, (9, 70, 1)).astype(np.uint16), np.zeros((300, 200, 1), np.uint8)]
    got = list(tiff.pages(tiff.write(images, compression=scheme, predictor=predictor, tile=tile, rows_per_strip=10, order=order)))
    assert [p.pixels for p in got] == [i.astype(i.dtype.newbyteorder("<")).tobytes() for i in images]
    assert [(p.number, p.width, p.height, p.samples, p.bits, p.tiled) for p in got][0] == (0, 53, 37, 3, 8, bool(tile))


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=9000) | st.binary(max_size=40).map(lambda b: b * 200))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data and tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_floating_predictor():
    x = np.array([[1.5, -2.25, 3.0], [0.0, 7.5, 1e9]], ">f4")
    planes = x.view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    coded = np.diff(planes, axis=1, prepend=np.zeros((2, 1), np.uint8)).astype(np.uint8)
    got = tiff.unpredicted(coded.tobytes(), 2, 3, 1, np.dtype("<u4"), tiff.FLOATING)
    assert (got.astype(">u4").view(">f4").reshape(2, 3) == x).all()


def test_pages_as_rows(spark):
    good = tiff.write([np.full((4, 5, 1), i, np.uint8) for i in range(3)])
    loop = bytearray(tiff.write([np.zeros((2, 2, 1), np.uint8)]))
    loop[-4:] = loop[4:8]  # the chain returns to its first page
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"not an image"), (5, good[:-200]), (6, bytes(loop)), (None, good)]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary"), key="doc_id").collect()
    n = Counter((r.doc_id, r.error is None) for r in got)
    assert n[1, True] == 6 and n[None, True] == 3 and n[4, False] == 1 and n[6, True] == 1 and not any(k in (2, 3) for k, _ in n) and n[5, False] == 1
    assert tiff.tiff_pages(spark.createDataFrame([], "doc_id long, media binary"), key="doc_id").count() == 0


def patched(data, **fields):
    """A copy of a little-endian file with one page and these fields' (count, value) in the directory; new ones take the place of PHOTOMETRIC."""
    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    (n,) = struct.unpack_from("<H", out, at)
    places = {struct.unpack_from("<H", out, at + 2 + 12 * i)[0]: at + 2 + 12 * i for i in range(n)}
    for name, (count, value) in fields.items():
        tag = getattr(tiff, name)
        struct.pack_into("<HHII", out, places.get(tag, places[tiff.PHOTOMETRIC]), tag, 4, count, value)
    return bytes(out)


def test_broken_files_are_error_rows(spark):
    """No file stops the task: those after it are read."""
    good = tiff.write([np.arange(200, dtype=np.uint8).reshape(10, 20, 1)])
    tiled = tiff.write([np.arange(200, dtype=np.uint8).reshape(10, 20, 1)], tile=(16, 16))
    bad = [patched(good, **f) for f in (
        {"ROWS_PER_STRIP": (1, 0)}, {"WIDTH": (1, 0)}, {"HEIGHT": (1, 0)}, {"WIDTH": (0, 0)}, {"WIDTH": (1, 1 << 31), "HEIGHT": (1, 1 << 31)}, {"HEIGHT": (1, 1 << 30), "ROWS_PER_STRIP": (1, 1 << 30)}, {"SAMPLES": (1, 0)},
        {"STRIP_OFFSETS": (0, 0)}, {"STRIP_OFFSETS": (1, 1 << 30)}, {"STRIP_COUNTS": (1 << 30, 8)}, {"COMPRESSION": (1, 7)}, {"PREDICTOR": (1, 9)}, {"BITS": (1, 13)}, {"BITS": (1, 1)}, {"BITS": (1, 2)}, {"BITS": (1, 4)}, {"PREDICTOR": (1, 3)},
    )] + [patched(tiled, TILE_WIDTH=(1, 0)), patched(tiled, TILE_HEIGHT=(0, 0)), good[:9], good[:60], b"II*\0" + b"\xff" * 4]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, good])], "doc_id long, media binary").coalesce(1)
    got = {r.doc_id: r for r in tiff.tiff_pages(df, key="doc_id").collect()}
    assert len(got) == len(bad) + 1 and all(got[i].error and got[i].pixels is None for i in range(len(bad)))
    assert got[len(bad)].error is None and bytes(got[len(bad)].pixels) == bytes(range(200)) and got[len(bad)].photometric == 1


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 400), st.binary(min_size=1, max_size=6))
def test_damaged_files_end_in_ordinary_errors(place, damage):
    data = bytearray(tiff.write([np.arange(60, dtype=np.uint8).reshape(6, 10, 1)], compression=tiff.LZW, tile=(16, 16)))
    place %= len(data)
    data[place : place + len(damage)] = damage
    try:
        assert all(len(p.pixels) <= tiff.MOST_PIXELS for p in tiff.pages(bytes(data)))
    except (ValueError, TypeError, struct.error, zlib.error):
        pass


def test_bits_from_the_low_end():
    x = np.arange(200, dtype=np.uint8).reshape(10, 20, 1)
    raw = bytearray(tiff.write([x], compression=tiff.NONE, predictor=tiff.NO_PREDICTOR))
    at = raw.index(bytes(range(200)))
    raw[at : at + 200] = bytes(int(f"{b:08b}"[::-1], 2) for b in range(200))
    assert next(tiff.pages(patched(raw, FILL_ORDER=(1, 2)))).pixels == bytes(range(200)) != next(tiff.pages(bytes(raw))).pixels


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_narrow_samples(bits):
    raw = tiff.write([np.arange(16, dtype=np.uint8).reshape(2, 8, 1) * 7], compression=tiff.NONE, predictor=tiff.NO_PREDICTOR)
    page = next(tiff.pages(patched(raw, BITS=(1, bits))))
    packed = np.unpackbits(np.arange(16, dtype=np.uint8) * 7).tolist()
    line = 8 * (-(-8 * bits // 8))
    want = [int("".join(map(str, packed[r * line + c * bits : r * line + (c + 1) * bits])), 2) for r in range(2) for c in range(8)]
    assert list(page.pixels) == want


def test_texts_are_stored_in_every_form():
    seen = set()
    for i in range(200):
        payload = (prose(i, 10 + i % 300).encode() + b"\0" * 64)[: 64 * (1 + i % 20)].ljust(64 * (1 + i % 20), b"\0")
        page = next(tiff.pages(tiff.as_image(payload)))
        assert page.pixels == payload
        seen.add((page.compression, page.predictor, page.tiled))
    assert seen == {(f.compression, f.predictor, f.tile is not None) for f in tiff.FORMS}


def test_stored_texts(docs, empty):
    by = {}
    for r in tiff.stored_texts(docs).collect():
        by.setdefault(r.media_sha256, set()).add((r.payload_sha256, r.feature))
    want = Counter()
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        want[r.doc_id, len(b), len(p), sha(p), zlib.crc32(p[-64:])] += 1
    got = tiff.stored_texts(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    assert Counter(tuple(r) for r in got) == want and all(len(x) == 1 for x in by.values())
    assert len(list(tiff.pages(tiff.as_image(b"x" * (64 * tiff.PAGE_ROWS + 64))))) == 2 and tiff.stored_texts(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\.", "<", "|", "[", "\n", "a", "é"]), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
    assert list(chat.parse(chat.render(text, text)))[0][:2] == (text, text)


def test_events_are_folded(spark):
    e = [
        (1, "a", 1, "message", "user", "hi"), (1, "b", 2, "message", "assistant", ""), (1, "b", 4, "delta", None, " world"), (1, "b", 3, "delta", None, "hello"), (1, "a", 9, "edit", None, "hi there"),
        (1, "c", 5, "message", "assistant", "wrong"), (1, "c", 6, "regenerate", None, None), (1, "c", 7, "delta", None, "right"), (1, "d", 8, None, "user", None), (1, "x", 8, "message", "user", "gone"), (1, "x", 10, "delete", None, None),
        (None, "a", None, "message", None, "no conversation"), (2, "a", 1, "delta", "assistant", "</s>"),
    ]
    events = spark.createDataFrame(e, "conv_id long, message_id string, seq long, kind string, role string, text string").withColumn("formatted", chat.F.lit(1)).repartition(5)
    got = {(r.conv_id, r.message_id): (r.seq, r.role, r.text) for r in chat.messages(events).collect()}
    assert got == {(1, "a"): (1, "user", "hi there"), (1, "b"): (2, "assistant", "hello world"), (1, "c"): (5, "assistant", "right"), (1, "d"): (8, "user", ""), (None, "a"): (None, "", "no conversation"), (2, "a"): (1, "assistant", "</s>")}
    after = [(3, "a", 1, "message", "user", "x"), (3, "a", 2, "delete", None, None), (3, "a", 3, "delta", None, "lost"), (3, "b", 4, "message", "assistant", "x"), (3, "b", 5, "delete", None, None), (3, "b", 6, "edit", "user", "back"), (3, "b", 7, "delta", None, "!")]
    assert [tuple(r)[1:] for r in chat.messages(spark.createDataFrame(after, "conv_id long, message_id string, seq long, kind string, role string, text string")).collect()] == [("b", 4, "assistant", "back!")]
    whole = {r.conv_id: r.formatted for r in chat.formatted(events).collect()}
    assert [(r, t) for r, t, _ in chat.parse(whole[1])] == [("user", "hi there"), ("assistant", "hello world"), ("assistant", "right"), ("user", "")] and list(chat.masked(whole[2])) == ["</s>"]
    d = {r.conv_id: r for r in chat.digests(events).collect()}
    assert d[1].n_turns == 4 and d[1].loss_sha256 == sha(b"hello worldright") and d[1].loss_chars == 16 and d[1].formatted_chars == len(whole[1])
    assert chat.digests(events.where("false")).count() == 0
    with pytest.raises(Exception, match="not known"):
        chat.messages(events.withColumn("kind", chat.F.lit("shout"))).count()


def test_conversations_are_read_back(spark, sf):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    rows[-1] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in queries.QUERIES["op6_chat_format"](spark, sf).collect()}
    assert set(got) == set(rows)
    for k, turns in rows.items():
        turns.sort()
        own = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(own), sha(own.encode()))


def test_vocabulary_must_be_byte_level():
    content = importlib.import_module("json").dumps({"model": {"type": "WordPiece"}, "pre_tokenizer": {"type": "ByteLevel"}})
    with pytest.raises(ValueError):
        bpe.Vocabulary(content)


def test_a_log_of_deltas_edits_and_regenerations_folds_to_the_messages(spark):
    texts = ["", "a", None, "</s>[INST] ok [/INST]", "\U0001f600é漢" * 40, "x" * 5000]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate((r, x) for r in ("user", "assistant", None) for x in texts)]
    rows += [(2, None, "assistant", "no turn"), (2, 5, "assistant", "twice"), (2, 5, "assistant", "twice"), (2, (1 << 63) - 1, "user", "last"), (2, -(1 << 63), "user", "first")]
    log = chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {chat.MESSAGE, chat.DELTA, chat.EDIT, chat.REGENERATE}
    got = Counter((r.conv_id, r.role, r.text) for r in chat.messages(log.repartition(7)).collect())
    assert got == Counter((c, r or "", x or "") for c, _, r, x in rows)
    order = [t for r in chat.formatted(log).where("conv_id = 2").collect() for _, t, _ in chat.parse(r.formatted)]
    assert order == ["no turn", "first", "twice", "twice", "last"]
