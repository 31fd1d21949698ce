"""Registered queries of the text operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import codes, digest, licenses, linetemplates, media, neardup, packing, postings, ppm, repeats, resample, target, wordtable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op9_minmax_neardup(spark, folder):
    found = neardup.near_duplicates(documents(spark, folder), words=2, percent=80)
    return found.withColumnRenamed("id", "doc_id")


#: Words of a text as this package cuts them, in SQL.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op9_minmax_neardup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWERED)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
rep AS (SELECT md5(array_to_string(list_sort(sh), chr(10))) AS h, min(doc_id) AS rep, any_value(sh) AS sh, count(*) AS n FROM s WHERE len(sh) > 0 GROUP BY 1),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM rep),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (SELECT rep, rep FROM rep UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1),
hs AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(list_sort(sh), chr(10))) END AS h FROM s)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM hs LEFT JOIN rep USING (h) LEFT JOIN comp ON comp.id = rep.rep
""".replace(", count(*) AS n FROM s", " FROM s")


@query
def op6_automaton_repeats(spark, folder):
    cut = repeats.remove_repeats(documents(spark, folder).select("doc_id", "text"), words=13, rejoin=True)
    return cut.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


ORACLES["op6_automaton_repeats"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 12], ' ')) AS h FROM g),
f AS (SELECT h, min(doc_id) AS low FROM k GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (h) WHERE low < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM p ANTI JOIN c USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op10_importance_resampling(spark, folder):
    drawn = resample.quality_sample(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return drawn.withColumnRenamed("id", "doc_id").drop("rid")


@query
def op5_line_templates(spark, folder):
    cut = linetemplates.drop_recurring_lines(documents(spark, folder).select("doc_id", "text"), min_verbatim=1)
    return cut.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op2_mixture_packing(spark, folder):
    return packing.pack(documents(spark, folder)).withColumnsRenamed({"id": "doc_id", "queue": "source"})


@query
def op1_quartile_digest(spark, folder):
    return digest.compare_edits(documents(spark, folder)).withColumnRenamed("id", "doc_id")


@query
def op8_media_sequences(spark, folder):
    return media.text_media(documents(spark, folder)).withColumnRenamed("id", "doc_id")


@query
def op7_word_table_bpe(spark, folder):
    coded = wordtable.encode(documents(spark, folder))
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_partial_matching(spark, folder):
    return ppm.score(documents(spark, folder), ppm.held_out()).withColumnRenamed("id", "doc_id")


@query
def op3_license_scan(spark, folder):
    return licenses.scan(documents(spark, folder)).withColumnRenamed("id", "doc_id")


@query
def op11_positional_index(spark, folder):
    found = postings.contamination(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), size=10)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


#: Words of digits, letters and bytes beyond ASCII, A-Z lower-cased, in SQL.
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op11_positional_index"] = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents), b AS (SELECT item_id, {_TERMS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, ws[i : i + least(len(ws), 10) - 1] AS t
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(t) AS n FROM iw),
dw AS (SELECT doc_id, i, n, ws[i : i + n - 1] AS t FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN sizes ON n <= len(ws))),
f AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM f) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM f) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""


@query
def op12_target_resampling(spark, folder):
    drawn = target.resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), percent=10, least=20, runs=1, buckets=10000)
    return drawn.withColumnRenamed("id", "doc_id")


ORACLES["op12_target_resampling"] = rf"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256))::BIGINT AS i))),
d AS (SELECT doc_id, {_TERMS} AS ws FROM documents), b AS (SELECT {_TERMS} AS ws FROM benchmark),
dt AS (SELECT doc_id, unnest(ws) AS w FROM d), bt AS (SELECT unnest(ws) AS w FROM b),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dt UNION ALL SELECT w FROM bt)),
x AS (SELECT w, list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(w), 2 * i - 1, 2))::BIGINT)) AS bytes FROM v),
h AS MATERIALIZED (SELECT w, xor(list_reduce(bytes, lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 AS k FROM x, tab),
s AS (SELECT k, count(*) AS s FROM dt JOIN h USING (w) GROUP BY 1), t AS (SELECT k, count(*) AS t FROM bt JOIN h USING (w) GROUP BY 1),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS g FROM s FULL JOIN t USING (k)),
wt AS (SELECT doc_id, floor(sum(g) / count(*))::BIGINT AS weight FROM dt JOIN h USING (w) JOIN g USING (k) GROUP BY 1),
sc AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id)
"""


@query
def op13_member_lloyd(spark, folder):
    coded = codes.compress(spark.read.parquet(f"{folder}/embeddings.parquet"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.withColumnRenamed("id", "vec_id")


def _lloyd_sql(rounds: int) -> str:
    """Rounds written out: ``a`` assigns parts, ``b`` holds entries."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, min(d * 256 + e) AS m FROM (SELECT r, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{k} USING (p, j) GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT p, e, j, coalesce(n, c) AS c FROM b{k} LEFT JOIN
  (SELECT p, m % 256 AS e, j, floor(sum(x) / count(*))::BIGINT AS n FROM x JOIN a{k} USING (r, p) GROUP BY 1, 2, 3) USING (p, e, j))""")
    return ",\n".join(steps)


ORACLES["op13_member_lloyd"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // (n // 4) AS p, (i - 1) % (n // 4) AS j, v[i] AS x FROM (SELECT r, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT p, e, j, x AS c FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM v) USING (r) WHERE e < 256),
{_lloyd_sql(4)},
o AS MATERIALIZED (SELECT r, string_agg(lower(lpad(hex(m % 256), 2, '0')), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY 1),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS s FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT s FROM h) AS codebooks_sha256 FROM v JOIN o USING (r)
"""
