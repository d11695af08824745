"""The registered queries of the document operators and the SQL that they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, chat, chunk_dedup, fim, repeats, secrets, simhash, source_mix, spelling, tiff, toxicity, url_trust, warc
from tidemill.llm._common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public tokenizers keeps a vocabulary."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("trust", "distrust")


def op2_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.as_events(own.unionByName(more)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), digests=True)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_trust": op1_url_trust,
    "op2_chunk_recipe_dedup": op2_chunk_recipe_dedup,
    "op3_tiff_pages": op3_tiff_pages,
    "op4_pareto_mix": op4_pareto_mix,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_chat_format": op6_chat_format,
    "op7_bpe": op7_bpe,
    "op8_simhash_groups": op8_simhash_groups,
    "op9_secret_forest": op9_secret_forest,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_warc_records": op13_warc_records,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _trust_sql(rounds: int = 60) -> str:
    """The verdicts with the ranks' rounds written out: more than they need to stand within the tolerance (0.85 ** 60 of 1 is 6e-5)."""
    host = lambda x: f"translate(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    link = r"""(?i)(?:href|src)\s*=\s*["'']?([^"''\s>]+)"""
    parts = [
        f"pages0 AS (SELECT page_id, html, {host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"ruled AS (SELECT *, CASE WHEN {fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {fits('example.com', '/de/')} THEN 'example.com/de/' WHEN {fits('org', '/fr/')} THEN 'org/fr/' WHEN {fits('net', '/')} THEN 'net/' END AS rule FROM pages0)",
        "decided AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM ruled)",
        f"links AS (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM pages0 WHERE host <> '')",
        f"edges AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, CASE WHEN starts_with(link, '//') THEN {host("'x:' || link")} WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {host('link')} ELSE host END AS dst FROM links) WHERE dst <> '' GROUP BY src, dst)",
        "shares AS (SELECT host, avg(CASE WHEN own = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS t, avg(CASE WHEN own = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS d FROM decided WHERE host <> '' GROUP BY host)",
        "seeds AS (SELECT 'trust' AS kind, host AS node, t / (SELECT sum(t) FROM shares) AS start FROM shares WHERE t > 0 UNION ALL SELECT 'distrust', host, d / (SELECT sum(d) FROM shares) FROM shares WHERE d > 0)",
        "ways AS (SELECT kind, node, dst, n / sum(n) OVER (PARTITION BY kind, node) AS share FROM (SELECT 'trust' AS kind, src AS node, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges))",
        "r0 AS (SELECT kind, node, start AS rank FROM seeds)",
    ]
    for i in range(rounds):
        parts += [
            f"m{i} AS MATERIALIZED (SELECT w.kind, w.dst AS node, sum(share * rank) AS moved FROM ways w JOIN r{i} r ON r.kind = w.kind AND r.node = w.node GROUP BY w.kind, w.dst)",
            f"r{i + 1} AS MATERIALIZED (SELECT kind, node, sum(x) AS rank FROM (SELECT kind, node, 0.85::DOUBLE * moved AS x FROM m{i} UNION ALL SELECT s.kind, node, start * (1 - 0.85::DOUBLE * coalesce(a.arrived, 0)) FROM seeds s LEFT JOIN (SELECT kind, sum(moved) AS arrived FROM m{i} GROUP BY kind) a ON a.kind = s.kind) GROUP BY kind, node)",
        ]
    return f"""WITH {', '.join(parts)}
        SELECT page_id, d.host, path, rule, coalesce(own, CASE WHEN bad / (good + bad) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM decided d LEFT JOIN (SELECT node, sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END) AS good, sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) AS bad FROM r{rounds} GROUP BY node) t ON t.node = d.host"""


def _chat_sql() -> str:
    control = lambda x: " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)
    escaped = lambda x: f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + 2 * ({control(x)}))"
    said = "'</s>[INST] ok [/INST]'"
    return f"""WITH own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(role, chr(0), text))) AS place FROM own)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY place)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
               CAST(sum({len(chat.TURN + chat.HEAD_END + chat.TURN_END) + 1} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars
        FROM placed GROUP BY conv_id"""


_FIM = """WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
        drawn AS (
            SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
                   CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM hashed),
        formed AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        cut AS (
            SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM formed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM cut"""

#: Edited pairs meet under the longer word without a letter, or under both words without the letter at one place.
_SPELLING = """WITH RECURSIVE runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]{7,}')) AS run FROM documents)),
        counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM runs GROUP BY doc_id, run),
        summed AS (
            SELECT *, xor(4294967295, list_reduce(list_transform(range(0, length(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)),
                lambda c, b: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295)) AS h FROM counted),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
            GROUP BY word HAVING sum(n) >= 2 AND length(word) >= 7),
        lacking AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
        pairs AS (
            SELECT a.word AS word, b.word AS near, b.n AS near_n FROM lacking a JOIN lacking b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM lacking a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM lacking a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -near_n, near := encode(near))) AS best FROM pairs GROUP BY word),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 10 * w.n THEN decode(best.near) END AS form,
                   CASE WHEN -best.n >= 10 * w.n THEN -best.n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word),
        ways AS (
            SELECT word, word AS root FROM forms WHERE form IS NULL
            UNION ALL SELECT f.word, w.root FROM forms f JOIN ways w ON f.form = w.word)
        SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms f JOIN ways USING (word)"""

_WARC = """WITH sized AS (SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        kept AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS keep FROM sized)
        SELECT page_id, payload_bytes, sha1(body) AS payload_digest, CASE WHEN page_id IS DISTINCT FROM keep AND keep IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
        FROM kept"""

#: Windows of 50 bytes as 100 hexadecimal digits; runs of removed bytes, and what lies between them.
_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        parts AS (SELECT doc_id, p, substr(h, 2 * p + 1, 898) AS part FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 400)) AS p FROM d)),
        windows AS (SELECT doc_id, p + i AS i, substr(part, 2 * i + 1, 100) AS s
            FROM (SELECT doc_id, p, part, unnest(range(0, least(400, length(part) // 2 - 49))) AS i FROM parts)),
        firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
        again AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE doc_id > least),
        begun AS (SELECT *, sum(CASE WHEN i <= last + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
            FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM again)),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM begun GROUP BY doc_id, run),
        cuts AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM runs
            UNION ALL SELECT d.doc_id, length(h) // 2, coalesce(max(b), 0) FROM d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id, h),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY since) AS k FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(k)) // 2 AS BIGINT) AS n_removed,
               CAST((SELECT count(*) FROM runs r WHERE r.doc_id = d.doc_id) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM d JOIN kept USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op5_repeated_bytes": _REPEATS,
    "op13_warc_records": _WARC,
    "op11_fill_in_middle": _FIM,
    "op12_spelling_variants": _SPELLING,
    "op1_url_trust": _trust_sql(),
    "op6_chat_format": _chat_sql(),
    "op2_chunk_recipe_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY body)""",
    "op4_pareto_mix": """
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                   (CAST('0x' || substr(md5('17:' || CAST(coalesce(doc_id, -1) AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
            FROM documents),
        sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        weighed AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS weight FROM sums),
        ratios AS (SELECT *, source_size * 3.0::DOUBLE / weight AS ratio FROM weighed),
        shares AS (
            SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
            FROM ratios WINDOW before AS (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT arg_min(share, ratio) AS level FROM shares WHERE share <= ratio),
        targets AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, level * weight) AS target FROM shares, level),
        weighted AS (SELECT *, CASE WHEN size >= 512 THEN 1.5::DOUBLE WHEN size >= 64 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM sized),
        classes AS (SELECT source, w, sum(size)::BIGINT AS class_size FROM weighted GROUP BY source, w),
        tried AS (
            SELECT c.source, c.w, class_size, source_size, target,
                   (target - 3.0::DOUBLE * coalesce(sum(class_size) OVER (PARTITION BY c.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / nullif(sum(class_size * w) OVER (PARTITION BY c.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS tried
            FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
        levels AS (SELECT source, arg_max(tried, w) AS lv FROM tried WHERE tried * w <= 3 GROUP BY source),
        parts AS (
            SELECT t.*, coalesce(CASE WHEN lv IS NOT NULL THEN least(3.0::DOUBLE, lv * w) END, CASE WHEN target > 0 THEN 3.0::DOUBLE ELSE 0 END) AS e
            FROM tried t LEFT JOIN levels l ON t.source IS NOT DISTINCT FROM l.source),
        rests AS (SELECT *, target - sum(floor(e) * class_size) OVER (PARTITION BY source) AS rest FROM parts),
        ranked AS (
            SELECT s.*, source_size, target, floor(e)::INT AS certain, e - floor(e) AS p, rest,
                   (u / (1 - u)) / CASE WHEN e - floor(e) > 0 THEN (e - floor(e)) / (1 - (e - floor(e))) END AS rank
            FROM weighted s JOIN rests t ON s.source IS NOT DISTINCT FROM t.source AND s.w = t.w),
        summed AS (
            SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle FROM ranked),
        decided AS (SELECT *, certain + CASE WHEN p > 0 AND middle <= rest THEN 1 ELSE 0 END AS copies FROM summed)
        SELECT doc_id, size, source_size, target, copies::INT AS copies, (copies * size)::BIGINT AS taken FROM decided""",
}
