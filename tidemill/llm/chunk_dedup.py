"""Exact deduplication of documents by content-defined chunk recipes.

Texts are cut into chunks where a rolling hash of the content says so. Chunks are
deduplicated to identifiers, and each identifier is verified: all byte strings that came
under it are compared, so that one identifier stands for one byte string. A document's
recipe is the ordered list of its identifiers, and two texts are equal when their recipes
are. Bytes move once, as chunks that were deduplicated within each task before; documents
are grouped, counted and joined by their recipes alone, about 16 bytes for 2 KB of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import flat, lower_ascii, settle, stored, steps

#: Chunk lengths in bytes: least, most, and the bits of the rolling hash that a cut needs to be zero.
LEAST, MOST, MASK_BITS = 512, 16384, 11
_WINDOW = 32
_GEAR = np.random.default_rng(20240517).integers(0, 1 << 32, 256, dtype=np.uint32)

#: Identifier functions, tried in this order until one verifies. The later ones are for data on which two byte strings share an identifier.
IDENTIFIERS: dict[str, Callable[[bytes], bytes]] = {
    "blake2b-128": lambda b: hashlib.blake2b(b, digest_size=16).digest(),
    "sha256": lambda b: hashlib.sha256(b).digest(),
    "sha512": lambda b: hashlib.sha512(b).digest(),
}


def candidate_cuts(data: np.ndarray, bits: int = MASK_BITS) -> np.ndarray:
    """Ascending positions after which the rolling hash of the last 32 bytes asks for a cut.

    The hash of a window is the sum of its bytes' random words, each shifted by its distance
    from the end; windows of 1, 2, 4 ... bytes are combined, so 32 bytes take five steps.
    """
    h, width = _GEAR[data], 1
    while width < _WINDOW:
        shifted = h[:-width] << np.uint32(width) if len(h) > width else h[:0]
        h[width:] += shifted
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1


def cut(data: bytes, found: np.ndarray, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """First and end of each chunk of ``data``; an empty text has none."""
    out, at, i, n = [], 0, 0, len(data)
    while at < n:
        i += int(np.searchsorted(found[i:], at + least))
        end = int(found[i]) if i < len(found) else n
        end = min(end, at + most, n)
        out.append((at, end))
        at = end
    return out


def recipes(docs: DataFrame, name: str, *, key: str = "doc_id", text: str = "text", identify: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(key, recipe binary, text_sha256 string, chunks array<struct<id, bytes>>), a row for each row of docs.

    ``chunks`` has the chunks that this task meets for the first time; a long run of equal
    chunks in one task is compared and dropped at once.
    """
    identify, width = identify or IDENTIFIERS[name], 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, seen, held = lower_ascii(), {}, 0
        for batch in steps(batches):
            lists, digests, ids, bodies, ends = [], [], [], [], [0]
            data, at = flat(batch.column(1))
            whole = data.tobytes().translate(lower)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                body = whole[a:b]
                digests.append(hashlib.sha256(body).hexdigest())
                cuts = cut(body, candidate_cuts(np.frombuffer(body, np.uint8))) if b - a > LEAST else [(0, b - a)] if b > a else []
                recipe = []
                for x, y in cuts:
                    piece = body[x:y]
                    recipe.append(i := identify(piece))
                    if seen.get(i) != piece:
                        ids.append(i)
                        bodies.append(piece)
                        if held < width * 16:
                            seen[i] = piece
                            held += len(piece)
                lists.append(b"".join(recipe))
                ends.append(len(ids))
            chunks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(bodies, pa.binary())], ["id", "bytes"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.binary()), pa.array(digests, pa.string()), chunks], ["key", "recipe", "text_sha256", "chunks"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, recipe binary, text_sha256 string, chunks array<struct<id: binary, bytes: binary>>")


def unverified(chunks: DataFrame) -> DataFrame:
    """The identifiers under which more than one byte string came: (id, n_bodies).

    Equal strings meet in the first aggregation, before and after one shuffle by (id, bytes);
    what is left for an identifier is one row.
    """
    distinct = chunks.groupBy("id").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    return distinct.where(F.col("least") != F.col("most")).select("id")


def verified_recipes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", identifiers: dict[str, Callable[[bytes], bytes]] = IDENTIFIERS) -> DataFrame:
    """(key, row, recipe, text_sha256) with identifiers that stand for one byte string each over all of docs."""
    for name, identify in identifiers.items():
        made = recipes(docs, name, key=key, text=text, identify=identify)
        kept = stored(made.withColumn("row", F.monotonically_increasing_id()))
        if not unverified(kept.select(F.explode("chunks").alias("c")).select("c.id", "c.bytes")).take(1):
            return kept.select("key", "row", "recipe", "text_sha256")
    raise ValueError("no identifier function tells all chunks apart")


def exact_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and
    all empty texts are one group. Of a group, the row with the largest key stays; a null key
    is below all others, and of rows that repeat a key (or of groups with null keys only) one row stays.
    """
    kept = verified_recipes(docs, key=key, text=text)
    best = F.max(F.struct(F.col("key"), F.col("row"))).alias("best")
    # The groups are a table of their own, so that both sides of the join are plain exchanges:
    # adaptive execution then splits a hot recipe, which is on the left side only.
    groups = settle(kept.groupBy("recipe").agg(best, F.count(F.lit(1)).alias("group_size")))
    return kept.join(groups, "recipe").select(
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Decisions are keyed by (key, text_sha256), so rows that repeat a key with other texts are
    told apart; of rows that repeat both, one stays.
    """
    groups = exact_groups(docs, key=key, text=text)
    stay = groups.where("kept").select(F.col(key).alias("__tidemill_key"), F.col("text_sha256").alias("__tidemill_sha"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sha = F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower()), 256)
    out = docs.withColumn("__tidemill_of", sha).join(stay.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__tidemill_key")) & (F.col("__tidemill_of") == F.col("__tidemill_sha")))
    if groups.where(~F.col("kept") & F.col(key).eqNullSafe(F.col("keep_id"))).take(1):
        out = out.dropDuplicates([key, "__tidemill_of"])
    return out.select(*docs.columns)
