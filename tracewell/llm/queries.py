"""The corpus operators as queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_warc, exact_dedup, license_scan, line_dedup, mixing, order_minhash, packing, quality_mil, quality_rules, toxicity
from .common import table


def _fold(col: str, mod: int, rest: int):
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(mod)) == rest


def _predicted(scored: DataFrame, held_out, cutoff: float) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    _, scores = toxicity.train_and_score(docs, labels, ~_fold("id", 3, 1))
    return _predicted(scores, _fold("id", 3, 1), 0.7)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    model = quality_mil.train(docs, labels, ~_fold("id", 5, 0))
    return _predicted(quality_mil.score(docs, model), _fold("id", 5, 0), 0.3)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return out.select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), F.size(lines).cast("long").alias("n_left"), "dropped_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "class_size", "n_links", "kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = arc_warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select(
        F.col("key").cast("long").alias("page_id"), F.col("length").alias("payload_bytes"), F.coalesce("computed", "declared").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="max")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_quality_classifier, op3_line_dedup, op4_order_minhash, op5_license_scan, op6_best_fit_packing, op7_arc_to_warc, op8_quality_rules, op9_mixing, op10_exact_dedup)}


def _license_sql() -> str:
    values = ",".join(f"({t},'{x}',{str(base).lower()},{n},'{spelt}',{k},'{a}','{b}','{la}','{lb}')" for t, x, base, n, spelt, k, a, b, la, lb in license_scan.template_rows())
    return f"""
WITH tpl(tid,label,base,length,spelt,tpos,a,b,la,lb) AS (VALUES {values}),
w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text,''),'{license_scan.UPPER}','{license_scan.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, unnest(range(len(w) - 1)) AS pos, w FROM w WHERE len(w) > 1),
g AS (SELECT r, pos, w[pos + 1] AS a, w[pos + 2] AS b FROM p),
h AS (SELECT r, tid, label, base, length, spelt, pos, pos - tpos AS diag, la, lb FROM g JOIN tpl USING (a, b)),
x AS (SELECT DISTINCT r, tid, label, base, length, spelt, diag FROM h),
n AS (SELECT x.*, h.pos, h.la, h.lb FROM x JOIN h ON h.r = x.r AND h.tid = x.tid AND h.diag BETWEEN x.diag AND x.diag + CASE WHEN x.base THEN 0 ELSE {license_scan.DRIFT} END),
c AS (SELECT r, tid, diag, pos AS spot, la AS c FROM n UNION SELECT r, tid, diag, pos + 1, lb FROM n),
k AS (SELECT *, spot - coalesce(lag(spot) OVER (PARTITION BY r, tid, diag ORDER BY spot) + 1, spot) AS gap FROM c),
o AS (SELECT r, tid, diag, string_agg(repeat('{license_scan.STRANGER}', gap::BIGINT) || c, '' ORDER BY spot) AS s, min(spot) AS first FROM k GROUP BY ALL),
m AS (SELECT x.*, o.first, greatest(0, x.length - levenshtein(o.s, x.spelt)) AS good FROM x JOIN o USING (r, tid, diag)),
d AS (SELECT r, count(*) FILTER (base AND good = length) AS n_base, min(first) FILTER (base AND good = length) AS first_word, max(first) FILTER (base AND good = length) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND good = length) AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN base THEN good = length ELSE good / length >= {license_scan.SHARE} END) AS labels, max(100 * good // length) / 100 AS score FROM m GROUP BY r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN d ON w.r = d.r"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
e AS (SELECT page_id, payload_bytes, x, list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (10 * (k // 8) + 1)::INT, 10))::BIGINT // (1::BIGINT << (35 - 5 * (k % 8))::INT)) % 32)::INT + 1, 1)), lambda a, b: a || b) AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

EXACT_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
n AS (SELECT doc_id, x, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) AS k FROM t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(x) AS text_sha256 FROM n"""


def _rules_sql() -> str:
    q = quality_rules
    values = {r: (v.split(" / ")[0], v.split(" / ")[1], width) for r, (v, width) in q.RULES.items()}
    buckets = ", ".join(f"least({q.BUCKETS - 1}, floor(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END / {w}::DOUBLE))::INT AS {r}" for r, (a, b, w) in values.items())
    stratum = "CASE " + " ".join(f"WHEN n_words < {limit} THEN {k}" for k, limit in enumerate(q.STRATA)) + f" ELSE {len(q.STRATA)} END"
    each, level = q.ALPHA / len(q.RULES), q.DELTA / ((len(q.STRATA) + 1) * len(q.RULES) * (q.BUCKETS - 1))
    rules = " UNION ALL ".join(f"SELECT r, stratum, quality, '{r}' AS rule, {r} AS bucket FROM held" for r in values)
    rejected = " OR ".join(f"coalesce({r} > (SELECT cut FROM best WHERE rule = '{r}' AND best.stratum = b.stratum), false)" for r in values)
    space = r"\x20\x09-\x0D"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS x FROM documents),
s AS (SELECT *, regexp_extract_all(x, '[^{space}]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^{space}]')) AS l FROM d),
g AS (SELECT r, unnest(range(len(w) - 2)) AS pos, w FROM s WHERE len(w) > 2),
t AS (SELECT r, pos, count(*) OVER (PARTITION BY r, w[pos + 1], w[pos + 2], w[pos + 3]) AS n FROM g),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS p FROM t WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, s.r, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[{space}]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM s LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {stratum} AS stratum, {buckets} FROM m),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
held AS (SELECT b.*, q.quality FROM b JOIN q USING (doc_id) WHERE NOT base_failed),
h AS (SELECT stratum, rule, bucket, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality <> 1) AS bad FROM ({rules}) GROUP BY ALL),
k AS (SELECT stratum, rule, cut, sum(good) FILTER (bucket > cut) AS x, sum(bad) FILTER (bucket > cut) AS bad, sum(good) AS n FROM h, (SELECT unnest(range({q.BUCKETS - 1})) AS cut) GROUP BY ALL),
v AS (SELECT stratum, rule, cut, coalesce(x, 0)::INT AS x, coalesce(bad, 0) AS bad, n::INT AS n FROM k),
a AS (SELECT *, CASE WHEN x >= n OR x >= n * {each}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(x + 1), lambda i: exp(lgamma(n + 1) - (CASE WHEN i < 1 THEN 0 ELSE lgamma(i + 1) END) - lgamma(n - i + 1) + i * ln({each}::DOUBLE) + (n - i) * ln(1 - {each}::DOUBLE)))) END AS tail FROM v),
best AS (SELECT stratum, rule, cut FROM a WHERE tail <= {level!r}::DOUBLE AND bad - {q.GOOD_WEIGHT} * x > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - {q.GOOD_WEIGHT} * x DESC, cut DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept FROM b"""


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, md5(x), source) - 1 AS no, CASE WHEN doc_id IS NULL THEN '' ELSE '=' || doc_id END || '|' || md5(x) AS key FROM d),
r AS (SELECT doc_id, source, size, ('0x' || substr(md5(CASE WHEN no = 0 THEN key ELSE key || '|' || no END), 1, 15))::BIGINT AS place FROM n),
t AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM r GROUP BY source),
w AS (SELECT *, (turn % 3 + 1)::DOUBLE AS weight, total * 3.0 AS most FROM t),
h AS (SELECT *, ((SELECT sum(total) FROM w)::DOUBLE - coalesce(sum(most) OVER u, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER u, 0)) AS rate
      FROM w WINDOW u AS (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, total, least(most::DOUBLE, coalesce(weight * (SELECT max(rate) FROM h WHERE most > weight * rate), most::DOUBLE)) AS target FROM w),
b AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS base FROM g),
c AS (SELECT r.*, b.total, b.target, b.base, b.target - b.base * b.total AS rest, coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, total AS source_size, target, (base * size + CASE WHEN rest > 0 AND before + size <= rest THEN size WHEN rest > 0 AND before < rest AND (rest - before) * 2 >= size THEN size ELSE 0 END)::BIGINT AS taken FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": _rules_sql(), "op9_mixing": MIXING_SQL, "op5_license_scan": _license_sql(), "op7_arc_to_warc": WARC_SQL, "op10_exact_dedup": EXACT_SQL}


__all__ = ["oracle_sql", "queries"]
