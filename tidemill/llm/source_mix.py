"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Every document of it is expected in a number of
copies in proportion to its weight, which goes by its length, and so that the expected words
meet the target: the whole part of that number is certain, and the fraction is the inclusion
probability p of one more copy. Documents are ranked by u/(1-u) divided by p/(1-p) with u a
hash of the document, and the copies go to the lowest ranks until the words that the
certain copies leave are filled: a sample of fixed size in words. Ranks fall into bins, so
that a hot source is cut by sums over bins, and only the bin with the cut is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._common import settle

#: Bins of a source's ranks at each of the two levels.
BINS = 4096
#: No document is taken more often than this, so no target exceeds this many times its source's size.
MOST_COPIES = 3
#: (least words, weight) by length: fragments are half as likely to be repeated as usual texts, long texts half as likely again.
LENGTH_WEIGHTS = ((0, 0.5), (64, 1.0), (512, 1.5))
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str | Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: str | Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, from the key alone: 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(-1)).cast("string")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST_COPIES) -> DataFrame:
    """sizes (source, source_size) with ``target``: a row for each source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes
    by weight. With the ratio source_size / weight ascending, the sources that stop at
    ``most`` times their size are a prefix, so the shares come from two running sums.
    """
    order = [F.col("source").isNull(), F.encode(F.col("source"), "UTF-8")]
    place = F.row_number().over(Window.orderBy(*order)) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    out = out.withColumn("ratio", F.col("source_size") * float(most) / F.col("weight"))
    by = Window.orderBy("ratio", *order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns(
        {
            "all_size": F.sum("source_size").over(Window.partitionBy()),
            "all_weight": F.sum("weight").over(Window.partitionBy()),
            "full_size": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "full_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # The share of one unit of weight if just the sources before this one are full.
    share = (F.col("all_size") - F.lit(float(most)) * F.col("full_size")) / (F.col("all_weight") - F.col("full_weight"))
    out = out.withColumn("share", F.when(share <= F.col("ratio"), share))
    level = F.first("share", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.select("source", "source_size", F.least(F.col("source_size") * float(most), F.coalesce(level, F.col("ratio")) * F.col("weight")).alias("target"))


def expected_copies(classes: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """(source, weight, expected): copies min(most, level * weight) with a level for each source that meets its target.

    classes: (source, weight, class_size, source_size, target), a row for each source and
    weight. The heaviest classes that stop at ``most`` copies are a prefix by weight, as in ``targets``.
    """
    by = Window.partitionBy("source").orderBy(F.col("weight").desc())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("class_size").over(before), F.lit(0))
    level = F.try_divide(left, F.sum(F.col("class_size") * F.col("weight")).over(after))
    out = classes.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("weight") <= F.lit(float(most)), F.col("level")))
    level = F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # Without a level, every class of the source stops at its most, or has no words.
    full = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)
    return out.select("source", "weight", F.coalesce(F.when(level.isNotNull(), F.least(F.lit(float(most)), level * F.col("weight"))), full).alias("expected"))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17, weights: tuple[float, ...] = (1.0, 2.0, 3.0), lengths: tuple[tuple[int, float], ...] = LENGTH_WEIGHTS) -> DataFrame:
    """One row per row of docs: key, size, source_size, target, copies, taken (words, copies counted).

    Null texts and texts without words have size 0: they fill no target, and get the copies that
    their ranks give them like others.
    Rows that repeat a key have the same rank and are taken together or, at the cut, by size.
    """
    weight = F.lit(None).cast("double")
    for least, value in lengths:
        weight = F.when(F.col("size") >= least, F.lit(float(value))).otherwise(weight)
    sized = settle(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size")).withColumn("weight", weight))
    # Tables of a row for each source, and for each source and weight.
    classes = settle(sized.groupBy("source", "weight").agg(F.sum("size").alias("class_size")))
    sums = targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights)
    classes = classes.join(sums.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    copies = expected_copies(classes).withColumnsRenamed({"source": "_of", "weight": "_weight"})
    classes = classes.join(copies, F.col("source").eqNullSafe(F.col("_of")) & (F.col("weight") == F.col("_weight"))).drop("_of", "_weight")
    classes = classes.withColumns({"certain": F.floor("expected").cast("int"), "p": F.col("expected") - F.floor("expected")})
    certain = F.sum(F.col("certain") * F.col("class_size")).over(Window.partitionBy("source"))
    sums = settle(classes.withColumn("left", F.col("target") - certain).drop("class_size", "expected").withColumnsRenamed({"source": "_of", "weight": "_weight"}))
    u = uniform("doc_id", seed)
    rank = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    # rank/(1+rank) lies between 0 and 1; its bins at two levels are integers.
    place = F.col("rank") / (1 + F.col("rank"))
    fine = F.least(F.floor(place * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("long")
    # A row for each source and weight: the left side's hot source is where adaptive execution splits.
    ranked = sized.join(sums, F.col("source").eqNullSafe(F.col("_of")) & (F.col("weight") == F.col("_weight"))).drop("_of", "_weight").withColumn("rank", rank)
    ranked = ranked.withColumns({"fine": fine}).withColumn("coarse", F.floor(F.col("fine") / BINS).cast("int"))

    def cut(rows: DataFrame, level: str, left: str) -> DataFrame:
        """For each source the first bin that ends beyond what is left, and the words before it."""
        w = Window.partitionBy("source").orderBy(level)
        bins = rows.groupBy("source", left, level).agg(F.sum("size").alias("in_bin"))
        bins = bins.withColumn("through", F.sum("in_bin").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        bins = bins.where(F.col("through") > F.col(left)).groupBy("source").agg(F.min(level).alias(f"{level}_cut"), F.min(F.col("through") - F.col("in_bin")).alias(f"{level}_before"))
        return bins.withColumnRenamed("source", "_of")

    def with_cut(rows: DataFrame, level: str, left: str) -> DataFrame:
        found = cut(rows, level, left)
        return rows.join(found, rows["source"].eqNullSafe(found["_of"]), "left").drop("_of")

    chosen = ranked.where("p > 0")
    first = settle(cut(chosen, "coarse", "left"))
    in_first = chosen.join(first, chosen["source"].eqNullSafe(first["_of"])).drop("_of").where("coarse = coarse_cut").withColumn("left2", F.col("left") - F.col("coarse_before"))
    second = settle(cut(in_first, "fine", "left2"))
    # What is left of the fine bin (about one row in 16 million of a source) is sorted by rank.
    tail = in_first.join(second, in_first["source"].eqNullSafe(second["_of"])).drop("_of").where("fine = fine_cut")
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    through = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    middle = through - F.col("size") / 2
    last = tail.withColumn("in", F.col("coarse_before") + F.col("fine_before") + middle <= F.col("left")).where("in").groupBy("source").agg(F.max(F.struct("rank", "doc_id", "size")).alias("last")).withColumnRenamed("source", "_of")
    cuts = first.join(second.withColumnRenamed("_of", "_of2"), F.col("_of").eqNullSafe(F.col("_of2")), "left").drop("_of2")
    cuts = settle(cuts.join(last.withColumnRenamed("_of", "_of3"), F.col("_of").eqNullSafe(F.col("_of3")), "left").drop("_of3"))
    out = ranked.join(cuts, ranked["source"].eqNullSafe(cuts["_of"]), "left").drop("_of")
    more = (
        F.when(F.coalesce(F.col("p"), F.lit(0.0)) <= 0, 0)
        .when(F.col("coarse_cut").isNull() | (F.col("coarse") < F.col("coarse_cut")), 1)
        .when(F.col("coarse") > F.col("coarse_cut"), 0)
        .when(F.col("fine") < F.col("fine_cut"), 1)
        .when(F.col("fine") > F.col("fine_cut"), 0)
        .when(F.col("last").isNotNull() & (F.struct("rank", "doc_id", "size") <= F.col("last")), 1)
        .otherwise(0)
    )
    out = out.withColumn("copies", (F.col("certain") + more).cast("int"))
    return out.select(F.col("doc_id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take_copies(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """docs as the mix has them: each row as often as its copies say, with all its columns."""
    made = mix(docs, key=key, source=source, text=text, seed=seed)
    decided = made.groupBy(F.col(key).alias("__tidemill_key"), F.col(source).alias("__tidemill_source"), F.col("size").alias("__tidemill_size")).agg(F.max("copies").alias("__tidemill_copies"))
    match = F.col(key).eqNullSafe(F.col("__tidemill_key")) & F.col(source).eqNullSafe(F.col("__tidemill_source")) & (words(text) == F.col("__tidemill_size"))
    out = docs.join(decided.where("__tidemill_copies > 0").hint("shuffle_hash"), match)
    return out.withColumn("__tidemill_copy", F.explode(F.sequence(F.lit(1), F.col("__tidemill_copies")))).select(*docs.columns)
