"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long tokens with a digit, and values assigned to names such as ``password``.
Their features are length, character transitions, dictionary coverage, path-likeness and
neighbouring words; the forest is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of the text before and after a candidate that count as its neighbours.
NEAR = 40

# Words that often stand before a secret, words that often stand before something else, and frequent words and syllables of prose and code.
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "bearer")
OTHER_NAMES = ("commit", "sha256", "sha1", "md5", "checksum", "digest", "uuid", "guid", "etag", "revision", "version", "invoice", "order", "isbn", "phone", "tel", "iban", "id", "ref", "file", "image", "page", "example", "sample")
WORDS = ("the", "and", "tion", "ing", "ent", "able", "that", "with", "for", "her", "his", "was", "not", "are", "this", "from", "have", "one", "all", "you", "der", "die", "und", "ein", "sch", "les", "des", "que", "pour", "dans", "los", "las", "para", "http", "www", "com", "org", "html", "index", "image", "main", "test", "user", "file", "data", "page", "name", "list", "src", "lib", "bin", "example", "sample", "change", "your")

_TOKEN = r"(?<![A-Za-z0-9_+/=.\-])[A-Za-z0-9_+/=.\-]{12,}+"
_SEGMENT = r"(?<![A-Za-z0-9_+=.\-])[A-Za-z0-9_+=.\-]{12,}+"
_VALUE = r"(?i)(?:" + "|".join(NAMES) + r")[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,}+)"
FEATURES = ("length", "transitions", "classes", "digits", "uppers", "hexes", "symbols", "distinct", "coverage", "slashes", "dots", "hyphens", "extension", "url_before", "named", "assigned", "quoted", "other_named")


#: Matches with what lies before them that make up NEAR characters at least, a match having 10 or more.
_AROUND = 5


def _split(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    """rows with the matches of a pattern in ``body`` and the gaps between them, one more than matches, and their ends.

    They are columns, as what a lambda function refers to would be evaluated for each element.
    """
    rows = rows.withColumns({f"_gaps{name}": F.split("body", pattern, -1), f"_found{name}": F.regexp_extract_all("body", F.lit(pattern), F.lit(0))})
    gaps, found = F.col(f"_gaps{name}"), F.col(f"_found{name}")
    length = lambda x: F.coalesce(F.length(x), F.lit(0))
    return rows.withColumns(
        {
            f"_steps{name}": F.zip_with(gaps, F.concat(F.array(F.lit("")), found), lambda g, f: length(g) + length(f)),
            f"_gap_ends{name}": F.transform(gaps, lambda x: F.right(x, F.lit(NEAR))),
            f"_gap_heads{name}": F.transform(gaps, lambda x: F.left(x, F.lit(NEAR))),
            f"_found_ends{name}": F.transform(found, lambda x: F.right(x, F.lit(NEAR))),
            f"_found_heads{name}": F.transform(found, lambda x: F.left(x, F.lit(NEAR))),
        }
    )


def _hits(name: str, value: str | None = None) -> Column:
    """Structs of the matches at the indices ``_kept``: what they are, the way from the last one, and their neighbours. Each looks at a few elements beside its own."""
    kept, steps, found = F.col(f"_kept{name}"), F.col(f"_steps{name}"), F.col(f"_found{name}")
    at = lambda column, i: F.get(F.col(f"{column}{name}"), i)

    def one(i: Column, k: Column) -> Column:
        last = F.coalesce(F.get(kept, k - 1), F.lit(-1))
        way = F.aggregate(F.slice(steps, last + 2, i - last), F.lit(0), lambda a, x: a + x)
        before, after = [], []
        for j in range(_AROUND, 0, -1):
            before += [at("_gap_ends", i - j), at("_found_ends", i - j)]
        for j in range(1, _AROUND + 1):
            after += [at("_gap_heads", i + j), at("_found_heads", i + j)]
        left, right = F.concat_ws("", *before, at("_gap_ends", i)), F.left(F.concat_ws("", *after), F.lit(NEAR))
        match = F.get(found, i)
        candidate = match if value is None else F.regexp_extract(match, value, 1)
        shift = F.length(match) - F.length(candidate)  # a value is the end of its match
        own = left if value is None else F.concat(left, F.left(match, shift))
        return F.struct(F.lit(name).alias("kind"), i.alias("nth"), way.alias("way"), shift.alias("shift"), candidate.alias("candidate"), F.right(own, F.lit(NEAR)).alias("before"), right.alias("after"))

    return F.transform(kept, one)


def findings(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, candidate, start, position, before, after): each candidate of each row at each of its places.

    position is the occurrence's own place (from 0) and has its neighbours; start is the first
    place at which the row has the same candidate. Tokens with slashes count whole and by their
    segments. A token that begins with ``name=`` of a secret's name counts by its value. Null
    and empty texts have none; rows that repeat have theirs again. The work grows in proportion to a text's
    length: matches are cut out with their neighbours in one pass, and only these short rows are
    dealt by their text's row, to add up the ways between them.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    for name, pattern in (("0", _TOKEN), ("1", _SEGMENT), ("2", _VALUE)):
        rows = _split(rows, pattern, name)
    token = lambda x: x.rlike("[0-9]") & ~x.rlike(f"(?i)^(?:{'|'.join(NAMES)})[:=]")
    places = lambda name, test: F.filter(F.transform(f"_found{name}", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumns({"_kept0": places("0", token), "_kept1": places("1", token), "_kept2": places("2", lambda x: F.lit(True))})
    rows = rows.select("_row", "key", F.concat(_hits("0"), _hits("1"), _hits("2", _VALUE)).alias("_all"))
    # Of explode() the optimizer would infer a filter and evaluate all columns below anew for it, for each element.
    rows = rows.select("_row", "key", F.explode_outer("_all").alias("one")).where("one IS NOT NULL").select("_row", "key", "one.*")
    along = Window.partitionBy("_row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("position", (F.sum("way").over(along) + F.col("shift")).cast("int"))
    each = placed.groupBy("_row", "position", "candidate").agg(F.first("key").alias("key"), F.first("before").alias("before"), F.first("after").alias("after"))
    start = F.min("position").over(Window.partitionBy("_row", "candidate"))
    return each.select("key", "candidate", start.alias("start"), "position", "before", "after")


def _share(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.greatest(F.length(of), F.lit(1))


def features(found: DataFrame) -> DataFrame:
    """found (candidate, before, after, ...) with FEATURES as doubles. Null neighbours count as empty."""
    c = F.coalesce(F.col("candidate"), F.lit(""))
    before, after = F.lower(F.coalesce("before", F.lit(""))), F.coalesce("after", F.lit(""))
    last = F.regexp_extract(before, r"([\p{L}\p{N}_\-]*)[^\p{L}\p{N}]*\z", 1)
    kinds = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"
    made = {
        "length": F.log1p(F.length(c)),
        "transitions": _share(kinds, c),
        "classes": c.rlike("[a-z]").cast("int") + c.rlike("[A-Z]").cast("int") + c.rlike("[0-9]").cast("int") + c.rlike("[^A-Za-z0-9]").cast("int"),
        "digits": _share("[0-9]", c),
        "uppers": _share("[A-Z]", c),
        "hexes": c.rlike("^[0-9a-fA-F]+$").cast("int"),
        "symbols": _share("[^A-Za-z0-9]", c),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.length(c), F.lit(1)),
        "coverage": (F.length(c) - F.length(F.regexp_replace(F.lower(c), "|".join(WORDS), ""))) / F.greatest(F.length(c), F.lit(1)),
        "slashes": _share("/", c),
        "dots": _share(r"\.", c),
        "hyphens": _share("-", c),
        "extension": c.rlike(r"(?i)\.[a-z]{2,4}[0-9]?\z").cast("int"),
        "url_before": before.rlike(r"(?:https?:|www\.|href|/)[^\s]*\z").cast("int"),
        "named": before.rlike("(?:" + "|".join(NAMES) + r")[\"']?\s{0,3}[:=]?\s{0,3}[\"']?\z").cast("int"),
        "assigned": before.rlike(r"[:=]\s{0,3}[\"']?\z").cast("int"),
        "quoted": (before.rlike(r"[\"']\z") & after.rlike("^[\"']")).cast("int"),
        "other_named": last.isin(*OTHER_NAMES).cast("int"),
    }
    clash = {x: f"input_{x}" for x in FEATURES if x in found.columns}
    return found.withColumnsRenamed(clash).withColumns({k: v.cast("double") for k, v in made.items()})


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(candidate, before, after, label): findings labelled by how they came about, ``rows`` of them.

    Half are credentials in the forms that services issue and configurations hold; the other
    half are what scanners report by mistake: checksums, revisions, identifiers, paths,
    versions, addresses, placeholders. The characters are digests of the row's number.
    """
    hexes = F.concat(F.md5(F.concat(F.lit("a"), F.col("id").cast("string"))), F.md5(F.concat(F.lit("b"), F.col("id").cast("string"))))
    base64 = F.regexp_replace(F.base64(F.unhex(hexes)), "[+/=\r\n]", "x")
    upper = F.translate(F.upper(base64), "0189", "2345")
    digits = F.translate(hexes, "abcdef", "012345")
    prose = F.element_at(F.array(*map(F.lit, ("the thing that was here ", "nicht aus der erde ", "une que les ", "para los que ", "a page of the report, ", "see also "))), (F.pmod(F.hash("id"), 6) + 1).cast("int"))
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64("id"), len(WORDS)) + 1).cast("int"))
    word2 = F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64("id", F.lit(2)), len(WORDS)) + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(F.xxhash64("id", F.lit(3)), len(NAMES)) + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, OTHER_NAMES)), (F.pmod(F.xxhash64("id", F.lit(4)), len(OTHER_NAMES)) + 1).cast("int"))
    size = (F.lit(16) + F.pmod(F.xxhash64("id", F.lit(5)), F.lit(25))).cast("int")
    of = lambda text, n: text.substr(F.lit(1), n if isinstance(n, Column) else F.lit(n))
    uuid = F.concat_ws("-", hexes.substr(1, 8), hexes.substr(9, 4), hexes.substr(13, 4), hexes.substr(17, 4), hexes.substr(21, 12))
    cat, none = F.concat, F.lit("")
    forms = [  # (candidate, before, after, label)
        (cat(F.lit("AKIA"), of(upper, 16)), prose, F.lit(" and then"), 1),
        (of(hexes, size), cat(prose, name, F.lit("=")), F.lit(" of the"), 1),
        (of(hexes, 40), cat(prose, name, F.lit(' = "')), F.lit('" in'), 1),
        (of(base64, size), cat(prose, name, F.lit(": ")), F.lit("\n"), 1),
        (cat(F.lit("ghp_"), of(base64, 36)), prose, F.lit(" "), 1),
        (cat(F.lit("sk_live_"), of(base64, 24)), cat(prose, F.lit('"')), F.lit('",'), 1),
        (cat(F.lit("xoxb-"), of(digits, 11), F.lit("-"), of(base64, 24)), prose, none, 1),
        (of(base64, 40), cat(prose, name, F.lit("='")), F.lit("'"), 1),
        (of(hexes, 40), cat(prose, other, F.lit(" ")), F.lit(" was"), 0),
        (hexes, cat(prose, F.lit("sha256: ")), F.lit("\n"), 0),
        (uuid, cat(prose, other, F.lit("=")), F.lit(" the"), 0),
        (cat(word, F.lit("/"), word2, F.lit("/"), of(digits, 3), F.lit("/"), word, F.lit(".html")), prose, F.lit(" for"), 0),
        (cat(word, F.lit("_"), word2, F.lit("-"), of(digits, 4), F.lit(".png")), cat(prose, F.lit("https://example.org/")), none, 0),
        (cat(word, word2, word, word2, of(digits, 2)), prose, F.lit(" "), 0),
        (cat(F.lit("+"), of(digits, 2), F.lit("-"), of(digits, 3), F.lit("-"), of(digits, 7)), cat(prose, F.lit("tel ")), F.lit(","), 0),
        (cat(F.lit("your-"), word, F.lit("-"), word2, F.lit("-here1")), cat(prose, name, F.lit("=")), none, 0),
    ]
    pick = F.pmod("id", len(forms))
    chosen = F.coalesce(*[F.when(pick == i, F.struct(c.alias("candidate"), b.alias("before"), a.alias("after"), F.lit(l).alias("label"))) for i, (c, b, a, l) in enumerate(forms)])
    return spark.range(0, rows, 1, 2).select(chosen.alias("x")).select("x.*")


def train(labelled: DataFrame, *, trees: int = 24, depth: int = 7, seed: int = 5) -> RandomForestClassificationModel:
    """A forest from (candidate, before, after, label 0/1). Rows without a label are left out."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(labelled.where("label IS NOT NULL").withColumn("label", F.col("label").cast("double"))))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.select("features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, candidate, start, position, score, is_secret) for every occurrence of a candidate; the forest is some thousand nodes."""
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings(docs, key=key, text=text))))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("key").alias(key), "candidate", "start", "position", score.alias("score"), (score >= threshold).alias("is_secret"))
