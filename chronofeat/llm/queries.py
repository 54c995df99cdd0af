"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, media, mixing, ngram_join, piece_encode, resample, sharding, suffix_dedup, token_count, url_filter, vector_codes
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=8)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, coverage=20)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.fit(url_filter.labelled_urls(spark)))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after three edits that follow from it: a cut, an insertion and a replacement."""
    docs, n = table(spark, sf_dir, "documents"), F.char_length("text")
    edit = lambda place, delete, insert: F.struct(place.cast("int").alias("place"), F.lit(delete).alias("delete"), insert.alias("insert"))
    edits = F.array(
        edit(F.floor(n / 2), 37, F.lit("")),
        edit(F.floor(n / 3), 0, F.concat(F.lit(" see "), F.coalesce("source", F.lit("?")), F.lit(": "))),
        edit(n - 5, 9, F.concat(F.substring("text", 1, 80), F.lit("."))),
    )
    return token_count.count_edited(docs.withColumn("edits", edits))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select(
        "doc_id",
        (F.length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, dictionaries, margin=0.05)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0, shards=8)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=2, buckets=10_000, percent=25, min_words=20, seed=7)


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encode.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Content of the given pages is their article; markup goes, references are decoded, blocks are lines.
OP6_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article|$)', 1, 's') AS inner_html FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(inner_html, '</?(p|h1)([^a-z0-9>][^>]*)?(>|$)'),
    lambda x: trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(x, '</?[a-zA-Z][^>]*(>|$)', ' ', 'g'), '&amp$', '&amp;'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a)
SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text,
       CAST(length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10))) AS BIGINT) AS n_chars
FROM b"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Pairs by shared shingles, components by reachability.
OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 3 THEN array_to_string(ws[i:i + 2], ' ') ELSE array_to_string(ws, ' ') END AS g FROM w, unnest(range(1, greatest(len(ws) - 1, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM w UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) m ON m.node = w.doc_id"""

#: Every document run of a window's length, joined with the windows.
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(ws[j:j + 12], ' ') AS g FROM i, unnest(range(1, greatest(len(ws) - 11, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS t(j)),
ks AS (SELECT DISTINCT k FROM win),
h AS (SELECT doc_id, j, x.k, item_id FROM (SELECT doc_id, j, ks.k, array_to_string(ws[j:j + ks.k - 1], ' ') AS g FROM d, ks, unnest(range(1, greatest(len(ws) - ks.k + 2, 1))) AS t(j)) x JOIN win ON win.g = x.g AND win.k = x.k),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(j, j + k)) AS t(q) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""


_SUM = "reduce(list_concat([4294967295], list_transform(range(0, CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: reduce(list_concat([xor(c, b)], range(0, 8)), lambda e, k: CASE WHEN e % 2 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END))"

#: The checksum of each different feature bit by bit, counts by bucket, scores and ranks.
OP11_SQL = rf"""
WITH w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, id, array_to_string(ws[i:i + k - 1], ' ') AS g FROM w, unnest([1, 2]) AS u(k), unnest(range(1, len(ws) - k + 2)) AS t(i)),
b AS (SELECT g, xor({_SUM}, 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT g, hex(encode(g)) AS x FROM f)),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (g) GROUP BY bucket),
n_all AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM n, n_all),
m AS (SELECT id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
d AS (SELECT id AS doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || sha256('7:' || id)[1:8] AS BIGINT) AS h FROM w LEFT JOIN m USING (id) WHERE side = 0),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, n_words >= 20 AS long_enough FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND place <= 25 * (SELECT count(*) FROM o WHERE long_enough) // 100 THEN place END AS rank FROM o"""


def sql_of_op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every point against every entry in each round."""
    nearest = "(SELECT id, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT pts.id, pts.p, pts.x, c.e, list_sum(list_transform(range(1, len(pts.x) + 1), lambda i: (pts.x[i] - c.x[i]) * (pts.x[i] - c.x[i]))) AS d FROM pts JOIN {0} c USING (p)) GROUP BY id, p, x)"
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"pts AS (SELECT vec_id AS id, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS x FROM v, unnest(range(0, {parts})) AS t(p))",
        f"c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, x FROM pts QUALIFY e < {entries})",
    ]
    for k in range(rounds):
        steps.append(f"a{k} AS {nearest.format(f'c{k}')}")
        steps.append(f"s{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY p, e, i) GROUP BY p, e)")
        steps.append(f"c{k + 1} AS (SELECT c{k}.p, c{k}.e, coalesce(s{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN s{k} USING (p, e))")
    steps.append(f"f AS {nearest.format(f'c{rounds}')}")
    steps.append("r AS (SELECT id, string_agg(lower(lpad(to_base(e, 16), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    head = ",\n".join(s.replace(" AS ", " AS MATERIALIZED ", 1) for s in steps)
    return f"WITH {head}\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v ON v.vec_id = r.id, h"


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": OP11_SQL, "op12_vector_code_compression": sql_of_op12(), "op1_ngram_jaccard_join": OP1_SQL, "op4_benchmark_decontamination": OP4_SQL, "op6_html_extraction": OP6_SQL}
