"""The TIFF reader on byte streams that are written out from the published format, not by the module's own encoders."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import tiff


def bit_string(codes):
    """(code, width) pairs, the highest bit first, filled up with zeros."""
    bits = "".join(f"{code:0{width}b}" for code, width in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_packbits_example():
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    plain = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22" + " AA" * 10)
    assert tiff.unpack_bits(packed, len(plain)) == plain
    assert tiff.unpack_bits(b"\x80" + packed, len(plain)) == plain  # -128 does nothing


def test_lzw_example():
    """Strings 7 | 7 7 | 8 | 8 | 7 7 | 6 | 6 between a clear code and the end."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    assert tiff.lzw_decode(bit_string([(c, 9) for c in codes]), 9) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))


def test_lzw_code_of_the_entry_being_made():
    assert tiff.lzw_decode(bit_string([(c, 9) for c in (256, 65, 258, 259, 257)]), 6) == b"AAAAAA"


@pytest.mark.parametrize("n", [200, 253, 254, 255, 256, 765, 766, 767, 1789, 1790, 1791, 3000])
def test_lzw_widths_grow_one_code_early(n):
    """Single bytes only: the j-th adds entry 257 + j, and after entry 511, 1023 and 2047 codes are a bit wider."""
    values = [(j * 37 + j // 256) % 256 for j in range(n)]
    codes = [(256, 9)]
    for j, v in enumerate(values):
        last = 257 + j  # the entry that the code before has added
        codes.append((v, 9 + (last >= 511) + (last >= 1023) + (last >= 2047)))
    last = 257 + n
    codes.append((257, 9 + (last >= 511) + (last >= 1023) + (last >= 2047)))
    assert tiff.lzw_decode(bit_string(codes), n) == bytes(values)


def file_of(fields, strips, order):
    """A file of one page: header, strips, then the directory; every field is LONG with one value, or its offset."""
    head = {"<": b"II", ">": b"MM"}[order]
    body, at, where = b"", 8, []
    for s in strips:
        where.append(at + len(body))
        body += s
    if len(body) % 2:
        body += b"\0"
    more = {**fields, 273: where, 279: [len(s) for s in strips]}
    base = at + len(body) + 2 + 12 * len(more) + 4
    entries, extra = b"", b""
    for tag in sorted(more):
        values = more[tag] if isinstance(more[tag], list) else [more[tag]]
        packed = struct.pack(f"{order}{len(values)}I", *values)
        entries += struct.pack(f"{order}HHI", tag, 4, len(values))
        if len(values) == 1:
            entries += packed
        else:
            entries += struct.pack(f"{order}I", base + len(extra))
            extra += packed
    return head + struct.pack(f"{order}HI", 42, at + len(body)) + body + struct.pack(f"{order}H", len(more)) + entries + bytes(4) + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_hand_made_files(order):
    """Two strips of two rows, the last with one row left, in each scheme; differences undone along rows for each sample."""
    rows = np.array([[10, 200, 12, 201, 14, 250], [0, 0, 255, 1, 254, 2], [9, 8, 7, 6, 5, 4]], np.uint8)  # three pixels of two samples
    turned = rows.astype(int)
    turned[:, 2:] -= rows[:, :-2].astype(int)
    turned = (turned % 256).astype(np.uint8)
    literal = lambda b: bytes((len(b) - 1,)) + b
    codes = lambda b: bit_string([(256, 9), *[(x, 9) for x in b], (257, 9)])
    schemes = {1: bytes, 5: codes, 8: zlib.compress, 32946: zlib.compress, 32773: literal}
    for scheme, made in schemes.items():
        for predictor, plain in ((1, rows), (2, turned)):
            fields = {256: 3, 257: 3, 258: [8, 8], 259: scheme, 262: 1, 277: 2, 278: 2, 317: predictor}
            data = file_of(fields, [made(plain[:2].tobytes()), made(plain[2:].tobytes())], order)
            (page,) = tiff.pages(data)
            assert (page.width, page.height, page.samples, page.bits, page.compression, page.predictor) == (3, 3, 2, 8, scheme, predictor)
            assert page.pixels == rows.tobytes(), (scheme, predictor)


def test_features_and_sizes_are_computed_anew(docs):
    """Feature from the text alone, size and digest from the stored file."""
    want = Counter()
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        times = np.bincount(np.frombuffer(p, np.uint8), minlength=256).tolist()
        bands = [sum(times[32 * i : 32 * i + 32]) / len(p) for i in range(8)]
        mean = sum(v * n for v, n in enumerate(times)) / len(p)
        feature = f"pages={-(-len(p) // 64 // tiff.PAGE_ROWS)};rows={len(p) // 64};mean={mean:.3f};bands={','.join(f'{x:.3f}' for x in bands)}"
        media = tiff.as_image(p)
        want[r.doc_id, feature, len(media), hashlib.sha256(media).hexdigest()] += 1
    got = tiff.stored_texts(docs).select("doc_id", "feature", "media_bytes", "media_sha256").collect()
    assert Counter(tuple(r) for r in got) == want
