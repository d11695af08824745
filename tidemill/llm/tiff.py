"""TIFF pages: a writer, and a reader that walks image directories and decodes strips and tiles.

The reader undoes PackBits, LZW and deflate, the horizontal and the floating-point
predictor, planes and tiles, in either byte order, and gives one row per page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import flat, steps

# Fixed values of the file format: compression schemes, predictors, tags, and field types' sizes in bytes.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NO_PREDICTOR, HORIZONTAL, FLOATING = 1, 2, 3
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FILL_ORDER, LOW_BIT_FIRST = 266, 2
FIELD_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4), 16: ("Q", 8)}

#: Bytes that a scheme makes of one byte at most: a run of deflate or PackBits, an LZW code that stands for 4096.
GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 128}
#: Bytes of a page's samples at most: what one binary value can hold.
MOST_PIXELS = (1 << 31) - 16
#: Pixel bytes that a task gathers before it passes its pages on.
HELD = 16 << 20
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    photometric: int  # as in the file: with 0 the samples count from white
    tiled: bool
    pixels: bytes  # rows from the top, samples of a pixel together, 16 and 32 bits little-endian


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < n and end - i < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out.append(end - i - 1)
        out += data[i:end]
        i = end
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2 if head > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the reader grows the width one code early (its table is one entry behind), and a full table is cleared."""
    bits, held, out = 0, 0, bytearray()
    codes, width, text = {bytes((b,)): b for b in range(256)}, 9, b""

    def put(code: int) -> None:
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    after = 258
    for b in data:
        longer = text + bytes((b,))
        if longer in codes:
            text = longer
            continue
        put(codes[text])
        codes[longer] = after
        after += 1
        if after == 4094:
            put(256)
            codes, width, after = {bytes((x,)): x for x in range(256)}, 9, 258
        elif after in (512, 1024, 2048):
            width += 1
        text = bytes((b,))
    if text:
        put(codes[text])
        after += 1
        if after in (512, 1024, 2048):
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, at, total = bytearray(), 0, len(data) * 8
    first = [bytes((b,)) for b in range(256)] + [b"", b""]
    words, width, last = list(first), 9, b""
    while at + width <= total and len(out) < size:
        i = at >> 3
        code = int.from_bytes(data[i : i + 4].ljust(4, b"\0"), "big") >> (32 - width - (at & 7)) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            words, width, last = list(first), 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif last and code == len(words):
            word = last + last[:1]
        else:
            raise ValueError("an LZW code that is not in the table")
        out += word
        if last:
            words.append(last + word[:1])
        last = word
        if len(words) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def decompressed(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {scheme} is not known")


def compressed(data: bytes, scheme: int) -> bytes:
    if scheme == LZW:
        return lzw_encode(data)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    return pack_bits(data) if scheme == PACKBITS else data


def predicted(block: np.ndarray, predictor: int) -> np.ndarray:
    """block: rows, columns, samples. Differences to the pixel on the left, in the samples' own width."""
    if predictor != HORIZONTAL:
        return block
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def unpredicted(raw: bytes, rows: int, columns: int, samples: int, kind: np.dtype, predictor: int) -> np.ndarray:
    if predictor == FLOATING:
        size = kind.itemsize
        planes = np.frombuffer(raw, np.uint8).reshape(rows, columns * samples * size)
        planes = np.cumsum(planes.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, columns, samples)
    block = np.frombuffer(raw, kind).reshape(rows, columns, samples)
    if predictor == HORIZONTAL:
        return np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
    if predictor != NO_PREDICTOR:
        raise ValueError(f"predictor {predictor} is not known")
    return block


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in FIELD_TYPES:
            continue
        code, size = FIELD_TYPES[kind]
        place = at + 10 + 12 * i
        if count * size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + count * size > len(data):
            raise ValueError(f"field {tag} lies beyond the end of the file")
        tags[tag] = struct.unpack_from(f"{order}{count}s" if code == "s" else f"{order}{count * len(code)}{code[0]}", data, place)
    (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, after


def _pixels(data: bytes, tags: dict[int, tuple], order: str) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        found = tags.get(tag, (default,))
        if not found or not isinstance(found[0], int):
            raise ValueError(f"field {tag} is missing or has no number")
        return found[0]

    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    scheme, predictor, separate, turned = one(COMPRESSION, NONE), one(PREDICTOR, NO_PREDICTOR), one(PLANAR, 1) == 2, one(FILL_ORDER, 1) == LOW_BIT_FIRST
    if any(b != bits for b in tags.get(BITS, (bits,))) or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError("samples of these widths are not known")
    if scheme not in GROWTH:
        raise ValueError(f"compression {scheme} is not known")
    if predictor not in (NO_PREDICTOR, HORIZONTAL, FLOATING) or predictor == HORIZONTAL and bits < 8 or predictor == FLOATING and bits not in (16, 32, 64):
        raise ValueError(f"predictor {predictor} is not known for samples of {bits} bits")
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if min(width, height, samples, across, down) < 1:
        raise ValueError("width, height, samples, strips and tiles must be 1 or more")
    kind = np.dtype(f"{'<' if order == '<' else '>'}u{max(1, bits // 8)}")
    inside = 1 if separate else samples
    by_row, by_column = -(-height // down), -(-width // across)
    offsets, counts = (tags.get(t, ()) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    if not len(offsets) == len(counts) == by_row * by_column * (samples if separate else 1):
        raise ValueError("the strips or tiles do not cover the page")
    line = -(-across * inside * bits // 8)
    for i, (start, length) in enumerate(zip(offsets, counts, strict=True)):
        # Before anything is allocated: a page can be as large only as its strips or tiles can make it.
        rows = down if tiled else min(down, height - i % by_row * down)
        if rows * line > max(0, min(length, len(data) - start)) * GROWTH[scheme] + GROWTH[scheme]:
            raise ValueError("a strip or tile is too short")
    if height * width * samples * kind.itemsize > MOST_PIXELS or down * line > MOST_PIXELS:
        raise ValueError("the page is larger than a binary value")
    out = np.zeros((height, width, samples), kind.newbyteorder("<"))
    for i, (start, length) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(i, by_row * by_column)
        top, left = rest // by_column * down, rest % by_column * across
        rows = down if tiled else min(down, height - top)
        body = data[start : start + length]
        raw = decompressed(body.translate(_TURNED) if turned else body, scheme, rows * line)
        if len(raw) < rows * line:
            raise ValueError("a strip or tile is too short")
        raw = raw[: rows * line]
        if bits < 8:
            lines = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : across * inside * bits]
            weights = 1 << np.arange(bits - 1, -1, -1)
            block = (lines.reshape(rows, across, inside, bits) * weights).sum(axis=3).astype(np.uint8)
        else:
            block = unpredicted(raw, rows, across, inside, kind, predictor)
        block = block[: height - top, : width - left]
        at = slice(plane, plane + 1) if separate else slice(None)
        out[top : top + block.shape[0], left : left + block.shape[1], at] = block
    return Page(0, width, height, samples, bits, scheme, predictor, one(PHOTOMETRIC, 1), tiled, out.tobytes())


def pages(data: bytes) -> Iterator[Page]:
    """The pages in the order of their directories. A chain that returns to itself ends there."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        tags, after = _directory(data, at, order)
        page = _pixels(data, tags, order)
        page.number = len(seen) - 1
        yield page
        at = after


@dataclass(frozen=True)
class Form:
    """How a page is stored; tile: (rows, columns), None for strips."""

    compression: int = DEFLATE
    predictor: int = HORIZONTAL
    tile: tuple[int, int] | None = None


def write(images: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = HORIZONTAL, rows_per_strip: int = 128, tile: tuple[int, int] | None = None, order: str = "<", forms: list[Form] | None = None) -> bytes:
    """A file with one page per image (rows, columns, samples) of unsigned 8 or 16 bits; forms: one for each page."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, form in zip(images, forms or [Form(compression, predictor, tile)] * len(images), strict=True):
        compression, predictor, tile = form.compression, form.predictor, form.tile
        height, width, samples = image.shape
        bits = image.dtype.itemsize * 8
        kind = image.dtype.newbyteorder(order)
        down, across = tile or (rows_per_strip, width)
        offsets, counts = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = image[top : top + down, left : left + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                body = compressed(predicted(block, predictor).astype(kind).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(body))
                out += body + b"\0" * (len(body) & 1)
        fields: list[tuple[int, str, list[int]]] = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [bits] * samples), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [2 if samples == 3 else 1])]
        if tile:
            fields += [(SAMPLES, "H", [samples]), (PREDICTOR, "H", [predictor]), (TILE_WIDTH, "I", [across]), (TILE_HEIGHT, "I", [down]), (TILE_OFFSETS, "I", offsets), (TILE_COUNTS, "I", counts)]
        else:
            fields += [(STRIP_OFFSETS, "I", offsets), (SAMPLES, "H", [samples]), (ROWS_PER_STRIP, "I", [down]), (STRIP_COUNTS, "I", counts), (PREDICTOR, "H", [predictor])]
        entries = b""
        for tag, code, values in sorted(fields):
            body = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(body) > 4:
                entries += struct.pack(order + "HHII", tag, 3 if code == "H" else 4, len(values), len(out))
                out += body
            else:
                entries += struct.pack(order + "HHI", tag, 3 if code == "H" else 4, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0)
    return bytes(out)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, photometric int, tiled boolean, pixels binary, error string"


def tiff_pages(media: DataFrame, *, key: str, media_col: str = "media") -> DataFrame:
    """One row per page: key and PAGE_SCHEMA.

    A null or empty file has no pages and no row. A file that is broken in any way, or whose
    page does not fit in memory, gives the pages before the break and then a row with
    ``error`` and null pixels; other files of the task are not touched. Samples come as they
    are stored (``photometric`` 0: they count from white). Rows that repeat give their pages
    again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", *(x.split()[0] for x in PAGE_SCHEMA.split(", "))]

        def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, *[pa.int32()] * 8, pa.bool_(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in steps(batches, "media"):
            rows, held, kind = [], 0, batch.schema.field(0).type
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = 0, pages(data) if data else iter(())
                while True:
                    try:
                        p = next(found, None)
                    except (Exception, MemoryError) as e:  # whatever is wrong with a file is that file's error row
                        rows.append((k, n, *[None] * 9, f"{type(e).__name__}: {e}"))
                        break
                    if p is None:
                        break
                    rows.append((k, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.photometric, p.tiled, p.pixels, None))
                    n, held = n + 1, held + len(p.pixels)
                    if held > HELD:
                        yield batch_of(rows, kind)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows, kind)

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(key).alias("key"), F.col(media_col).alias("media")).mapInArrow(run, f"key {kind}, {PAGE_SCHEMA}").withColumnRenamed("key", key)


#: Bytes of a row of pixels, and rows of a page, when a text is stored as an image.
ROW, PAGE_ROWS = 64, 16384
#: A page is stored in one of these, by the checksum of its samples: equal texts are stored alike.
FORMS = (Form(LZW), Form(PACKBITS, NO_PREDICTOR), Form(LZW, NO_PREDICTOR, (64, 32)), *[Form(DEFLATE, HORIZONTAL, (64, 32))] * 5, *[Form(DEFLATE, NO_PREDICTOR)] * 4, *[Form()] * 20)


def as_image(payload: bytes) -> bytes:
    """The payload (a multiple of 64 bytes) as 8-bit samples, 64 to a row and at most 1 MB to a page."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW, 1)
    parts = [samples[i : i + PAGE_ROWS] for i in range(0, len(samples), PAGE_ROWS)]
    return write(parts, forms=[FORMS[zlib.crc32(p) % len(FORMS)] for p in parts])


def stored_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a TIFF file, read back page by page, with the digests of both forms.

    Null counts as empty, which is stored as 64 zero bytes. The feature is computed from the
    samples that were read: pages, rows, mean and the shares of eight brightness bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in steps(batches):
            data, at = flat(batch.column(1))
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = b - a
                media = as_image(data[a:b].tobytes() + b"\0" * (max(ROW, -(-n // ROW) * ROW) - n))
                read = list(pages(media))
                back = b"".join(p.pixels for p in read)
                bands = np.bincount(np.frombuffer(back, np.uint8) >> 5, minlength=8)
                feature = f"pages={len(read)};rows={sum(p.height for p in read)};mean={np.frombuffer(back, np.uint8).mean():.3f};bands={','.join(f'{x / len(back):.3f}' for x in bands)}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("key", key)
