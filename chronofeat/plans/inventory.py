"""Further registered queries of operators that the main registry does not show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geo
from ..operators import evidence, filters, link, reports, resolve, roads, sets, spatial
from ..sources import normalize
from .registry import ESTIMATE, _estimates, query

# ---------------------------------------------------------------- C, D


@query(ESTIMATE.replace("SELECT d.building_id,", ", est AS (SELECT d.building_id,", 1) + ") SELECT building_id, start_year, confidence FROM est WHERE start_year >= 1880 AND start_year <= 1920 AND confidence >= 0.5")
def c13_filter_estimates(v):
    return filters.filter_estimates(_estimates(v), 1880, 1920, 0.5).select("building_id", "start_year", F.round("confidence", 3).alias("confidence"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def c16_split_current(v):
    return filters.split_current(v.table("orders"), "o_orderstatus", ["F"])[0].select("o_orderkey", "o_orderstatus")


@query("""WITH c AS (SELECT p.id, min(b.ord) AS ord FROM registry_points p JOIN base_features b ON p.x > b.x0 AND p.x < b.x1 AND p.y > b.y0 AND p.y < b.y1 GROUP BY p.id),
    n AS (SELECT p.id, b.ord, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(p.x - (b.x0 + b.x1) / 2.0, 2) + pow(p.y - (b.y0 + b.y1) / 2.0, 2)), b.ord) AS k FROM registry_points p JOIN base_features b ON abs(p.x - (b.x0 + b.x1) / 2.0) <= 120 AND abs(p.y - (b.y0 + b.y1) / 2.0) <= 120
        WHERE sqrt(pow(p.x - (b.x0 + b.x1) / 2.0, 2) + pow(p.y - (b.y0 + b.y1) / 2.0, 2)) <= 120)
    SELECT p.id, coalesce(c.ord, n.ord) AS ord FROM registry_points p LEFT JOIN c ON c.id = p.id LEFT JOIN n ON n.id = p.id AND n.k = 1""")
def d9_building_at_point(v):
    return link.building_at_point(v("registry_points").select("id", "x", "y"), v("base_features"), 120.0)


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def d16_enrich_by_ref(v):
    roads = v.table("lineitem").select("l_orderkey", "l_linenumber", F.lit("F").alias("category"), F.col("l_orderkey").alias("number"))
    register = v.table("orders").select(F.lit("F").alias("category"), F.col("o_orderkey").alias("number"), "o_orderpriority")
    return link.enrich_by_number(roads, register, ("category", "number"), "o_orderpriority").select("l_orderkey", "l_linenumber", "o_orderpriority")


@query(ESTIMATE.replace("SELECT d.building_id,", ", est AS (SELECT d.building_id,", 1) + ") SELECT e.building_id, e.start_year, b.src FROM est e JOIN base_features b ON b.ord = e.building_id WHERE method = 'exact' ORDER BY start_year, e.building_id LIMIT 5")
def d19_oldest_exact(v):
    found = _estimates(v).where("method = 'exact'").join(v("base_features").select(F.col("ord").alias("building_id"), "src"), "building_id")
    return sets.first_rows(found, 5, "start_year", "building_id").select("building_id", "start_year", "src")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def d22_apply_labels(v):
    return link.enrich(v.table("documents"), v.table("labels"), "doc_id", "quality", "toxic").select("doc_id", "source", "quality", "toxic")


# ---------------------------------------------------------------- E


@query("SELECT 'inputs' AS part, src AS name, count(*) AS n FROM date_features GROUP BY src UNION ALL SELECT 'output', src, count(*) FROM base_features GROUP BY src UNION ALL SELECT 'dated', src, count(sd) FROM base_features GROUP BY src")
def e3_merge_report(v):
    return reports.merge_report(v("date_features"), v("base_features"))


@query("SELECT evidence_type, count(*) AS n, count(DISTINCT building_id) AS buildings, count(end_year) AS with_end FROM evidence GROUP BY evidence_type")
def e7_store_stats(v):
    return reports.store_stats(v("evidence"))


@query("""SELECT id, count(DISTINCT map_year) AS checked, count(DISTINCT CASE WHEN found THEN map_year END) AS seen, min(CASE WHEN found THEN map_year END) AS verified_by, CASE WHEN count(DISTINCT CASE WHEN found THEN map_year END) >= 3 THEN 'h' WHEN count(DISTINCT CASE WHEN found THEN map_year END) = 2 THEN 'm' ELSE 'l' END AS ev
    FROM (SELECT l_orderkey AS id, CAST(1880 + l_linenumber % 4 * 20 AS INT) AS map_year, l_returnflag = 'N' AS found FROM lineitem) GROUP BY id""")
def e10_fold_detections(v):
    rows = v.table("lineitem").select(F.col("l_orderkey").alias("id"), (1880 + F.col("l_linenumber") % 4 * 20).cast("int").alias("map_year"), (F.col("l_returnflag") == "N").alias("found"), F.col("l_discount").alias("confidence"))
    return resolve.fold_detections(rows).select("id", "checked", "seen", "verified_by", "ev")


@query("SELECT CASE WHEN sure IS NULL THEN 'no coverage' ELSE CASE WHEN found THEN 'existed' ELSE 'absent' END || CASE WHEN sure >= 0.7 THEN ', sure' ELSE ', unsure' END END AS bucket, count(*) AS n FROM (SELECT p_size % 2 = 0 AS found, CASE WHEN p_size % 7 > 0 THEN p_size / 50.0 END AS sure FROM part) GROUP BY 1")
def e11_presence_stats(v):
    size = F.col("p_size")
    return reports.presence_stats(v.table("part").select((size % 2 == 0).alias("found"), F.when(size % 7 > 0, size / 50.0).alias("sure")))


@query("SELECT count(*) AS n, count(sd) AS dated, min(sd) AS first_year, max(sd) AS last_year FROM base_features")
def e15_summary(v):
    return reports.stats_by_group(v("base_features").withColumn("all", F.lit(1)), "all").join(reports.count_by(v("base_features").withColumn("all", F.lit(1)), "all").select("all", "dated"), "all").select("n", "dated", "first_year", "last_year")


@query("SELECT did % 1000 AS seed, min(sd) AS sd, max(sd + 40) AS ed, count(*) AS n, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM date_features GROUP BY 1")
def e16_merge_group(v):
    rows = v("date_features").withColumn("seed", F.col("did") % 1000).withColumn("ed", F.col("sd") + 40).withColumn("confidence", F.lit(1.0)).withColumnRenamed("did", "id")
    return resolve.merge_group(rows).select("seed", "sd", "ed", "n", F.array_join("src_all", ",").alias("sources"))


@query("SELECT kind, n FROM (SELECT c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 1) ORDER BY n DESC, kind LIMIT 3")
def e19_registry_profile(v):
    return reports.top(v("registry_points"), "kind", 3)


@query("SELECT src, count(*) AS n FROM base_features WHERE coalesce(sd, 1960) <= 1990 AND (ed IS NULL OR ed >= 1990) GROUP BY src")
def e21_source_counts(v):
    return reports.source_counts(v("base_features"), 1990)


@query("SELECT l_suppkey AS map_id, round(avg(l_extendedprice) - avg(l_quantity) * ((max(l_extendedprice) - min(l_extendedprice)) / (max(l_quantity) - min(l_quantity))), 4) AS x0, round(avg(l_discount) + avg(l_tax) * ((max(l_discount) - min(l_discount)) / (max(l_tax) - min(l_tax))), 6) AS y1 FROM lineitem GROUP BY l_suppkey")
def e28_gcp_bounds(v):
    gcps = v.table("lineitem").select(F.col("l_suppkey").alias("map_id"), F.col("l_quantity").alias("pixel_x"), F.col("l_tax").alias("pixel_y"), F.col("l_extendedprice").alias("geo_x"), F.col("l_discount").alias("geo_y"))
    sizes = v.table("supplier").select(F.col("s_suppkey").alias("map_id"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    return reports.gcp_bounds(gcps, sizes).select("map_id", F.round("x0", 4).alias("x0"), F.round("y1", 6).alias("y1"))


@query("SELECT n_name AS source, count(c_custkey) AS raw, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS normalized FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def e31_status(v):
    nation = v.table("nation").select(F.col("n_name").alias("source"), "n_nationkey")
    rows = v.table("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("source", F.col("c_custkey").alias("id"), "c_acctbal")
    return reports.status(nation, rows, F.col("c_acctbal") > 0)


# ---------------------------------------------------------------- F


@query("""SELECT r.id AS road, CAST(trunc(median(p.sd)) AS INT) AS median_year, min(p.sd) AS first_year, count(*) AS buildings FROM roads r JOIN registry_points p ON p.x BETWEEN r.x0 - 300 AND r.x1 + 300 AND p.y BETWEEN r.y0 - 300 AND r.y1 + 300
    WHERE sqrt(pow((p.x - r.x0) - least(greatest(((p.x - r.x0) * (r.x1 - r.x0) + (p.y - r.y0) * (r.y1 - r.y0)) / CAST((r.x1 - r.x0) * (r.x1 - r.x0) + (r.y1 - r.y0) * (r.y1 - r.y0) AS DOUBLE), 0.0), 1.0) * (r.x1 - r.x0), 2)
      + pow((p.y - r.y0) - least(greatest(((p.x - r.x0) * (r.x1 - r.x0) + (p.y - r.y0) * (r.y1 - r.y0)) / CAST((r.x1 - r.x0) * (r.x1 - r.x0) + (r.y1 - r.y0) * (r.y1 - r.y0) AS DOUBLE), 0.0), 1.0) * (r.y1 - r.y0), 2)) <= 300 GROUP BY r.id""")
def f10_years_from_buildings(v):
    return roads.years_near_roads(v("roads"), v("registry_points"), 300.0, cell=300.0).where("dated > 0").select("road", "median_year", "first_year", F.col("dated").alias("buildings"))


@query("SELECT id, CASE WHEN src = 'nvdb' THEN 'current' ELSE 'removed' END AS status, CASE WHEN src = 'nvdb' THEN ed ELSE coalesce(ed, 1950) END AS ed FROM roads")
def f12_classify_current(v):
    return resolve.classify_current(v("roads").withColumn("src_all", F.array("src")), ["nvdb"]).select("id", "status", "ed")


@query("SELECT id, CASE WHEN lss >= 0.8 AND h <= 10 AND w THEN 'widened' WHEN lss >= 0.8 AND h <= 10 THEN 'same' WHEN e AND lss >= 0.3 THEN 'rerouted' ELSE 'replaced' END AS change FROM (SELECT p_partkey AS id, p_size % 11 / 10.0 AS lss, p_size % 17 AS h, p_size % 2 = 0 AS w, p_size % 3 = 0 AS e FROM part)")
def f13_classify_change(v):
    size = F.col("p_size")
    rows = v.table("part").select(F.col("p_partkey").alias("id"), (size % 11 / 10.0).alias("lss"), (size % 17).alias("hausdorff"), (size % 2 == 0).alias("width_change"), (size % 3 == 0).alias("same_ends"))
    return resolve.classify_change(rows).select("id", "change")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 1880 WHEN c_custkey % 2 = 0 THEN 1950 ELSE 1900 END AS sd, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 1881 END AS sd_min FROM customer")
def f15_apply_presence(v):
    key = F.col("c_custkey")
    rows = v.table("customer").select(key.alias("id"), F.when(key % 2 == 0, 1950).otherwise(1900).alias("sd"))
    return resolve.apply_presence(rows, rows.where("id % 3 = 0")).select("id", "sd", "sd_min")


@query("""WITH q AS (SELECT -1 - o_orderkey AS id, (o_orderkey * 7919) % 40000 AS x, (o_orderkey * 104729) % 15000 AS y FROM orders), d AS (SELECT id, x, y, sd FROM registry_points WHERE ev IN ('h', 'm')),
    p AS (SELECT q.id, d.id AS donor, d.sd, sqrt(pow(CAST(q.x - d.x AS DOUBLE), 2) + pow(CAST(q.y - d.y AS DOUBLE), 2)) AS distance FROM q, d), m AS (SELECT id, CAST(trunc(median(sd)) AS INT) AS near FROM p WHERE distance <= 500 GROUP BY id), n AS (SELECT id, sd AS far FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, donor) AS k FROM p) WHERE k = 1)
    SELECT q.id, coalesce(near, far) AS sd, CASE WHEN near IS NOT NULL THEN 'median' ELSE 'nearest' END AS sd_method FROM q LEFT JOIN m ON m.id = q.id LEFT JOIN n ON n.id = q.id""")
def f2_inherit_dates_tiered(v):
    """Every order asks all registry points."""
    key = F.col("o_orderkey")
    asked = v.table("orders").select((-1 - key).alias("id"), ((key * 7919) % 40_000).alias("x"), ((key * 104_729) % 15_000).alias("y"), F.lit(None).cast("int").alias("sd"), F.lit("l").alias("ev"))
    out = resolve.inherit_dates_tiered(asked.union(v("registry_points").select("id", "x", "y", "sd", "ev")), 500.0, scale=(1.0, 1.0))
    return out.where("id < 0").select("id", "sd", "sd_method")


_CROSS = "CAST((a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) AS DOUBLE)"


@query(f"""WITH l AS (SELECT id, x0, y0, x1, y1 FROM roads UNION ALL SELECT id + 1000000000, x0, y1, x1, y0 FROM roads UNION ALL SELECT id + 2000000000, x0 - 200, y0 + 40, x1 + 300, y0 + 40 FROM roads),
    p AS (SELECT a.id, {_CROSS} AS cross, ((b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0)) / {_CROSS} AS t, ((b.x0 - a.x0) * (a.y1 - a.y0) - (b.y0 - a.y0) * (a.x1 - a.x0)) / {_CROSS} AS u
        FROM l a JOIN l b ON a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND least(a.y0, a.y1) <= greatest(b.y0, b.y1) AND least(b.y0, b.y1) <= greatest(a.y0, a.y1) WHERE {_CROSS} <> 0),
    o AS (SELECT a.id, unnest([b.x0 - a.x0, b.x1 - a.x0]) / CAST(a.x1 - a.x0 AS DOUBLE) AS t FROM l a JOIN l b ON a.id <> b.id AND a.y0 = a.y1 AND b.y0 = b.y1 AND a.y0 = b.y0 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
    c AS (SELECT DISTINCT id, round(t, 9) AS t FROM p WHERE u BETWEEN 0 AND 1 AND t > 0 AND t < 1 UNION SELECT id, round(t, 9) FROM o WHERE t > 0 AND t < 1), e AS (SELECT id, t FROM c UNION SELECT id, 0.0 FROM l UNION SELECT id, 1.0 FROM l),
    n AS (SELECT id, t, lead(t) OVER (PARTITION BY id ORDER BY t) AS t1, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS part FROM e)
    SELECT l.id, CAST(part AS INT) AS part, round(x0 + (x1 - x0) * t, 4) AS x0, round(y0 + (y1 - y0) * t, 4) AS y0, round(x0 + (x1 - x0) * t1, 4) AS x1, round(y0 + (y1 - y0) * t1, 4) AS y1 FROM n JOIN l ON l.id = n.id WHERE t1 IS NOT NULL""")
def f20_split_at_crossings(v):
    """Roads, their mirror images and level lines over them, so that they cross, join and overlap."""
    plain = v("roads").select("id", "x0", "y0", "x1", "y1")
    mirrored = plain.select(F.col("id") + 1_000_000_000, "x0", F.col("y1"), "x1", F.col("y0"))
    level = plain.select(F.col("id") + 2_000_000_000, F.col("x0") - 200, F.col("y0") + 40, F.col("x1") + 300, F.col("y0") + 40)
    return roads.split_at_crossings(plain.union(mirrored).union(level), digits=4)


# ---------------------------------------------------------------- G, H


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def g5_recent(v):
    return sets.first_rows(v.table("events"), 10, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY source, doc_id LIMIT 40")
def g6_unlabelled(v):
    return link.unmatched(v.table("documents"), v.table("labels"), "doc_id").orderBy("source", "doc_id").limit(40).select("doc_id", "source")


@query("SELECT o_custkey AS code, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def h5_dedup_keep_last(v):
    return sets.dedup_keep_last(v.table("orders").withColumnRenamed("o_custkey", "code"), "code", "o_orderkey").select("code", "o_orderkey")


@query("SELECT c_custkey AS id, 'old' AS side FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def h4_new_only(v):
    rows = v.table("customer").select(F.col("c_custkey").alias("id"))
    return sets.new_only(rows.where("id % 2 = 0").withColumn("side", F.lit("old")), rows.where("id % 3 = 0").withColumn("side", F.lit("new")), "id")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def h6_dedup_by_content(v):
    return sets.dedup_by_content(v.table("part").select("p_brand", "p_size", F.lit(None).cast("string").alias("uuid")), ["uuid"]).select("p_brand", "p_size")


@query("SELECT ord, src FROM base_features WHERE src <> 'matrikkelen' UNION ALL SELECT id, 'matrikkelen' FROM registry_points")
def h10_replace_source(v):
    return sets.replace_source(v("base_features").select("ord", "src"), v("registry_points").select(F.col("id").alias("ord"), F.lit("matrikkelen").alias("src")), "matrikkelen")


# ---------------------------------------------------------------- I, J


@query("SELECT ord, coalesce(sd BETWEEN 1700 AND 2030, false) AS ok FROM base_features")
def i4_is_valid_year(v):
    return v("base_features").select("ord", F.coalesce(dates.is_valid_year(F.col("sd")), F.lit(False)).alias("ok"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y FROM orders")
def i5_year_of_slashed_date(v):
    shown = F.concat(F.month("o_orderdate"), F.lit("/"), F.dayofmonth("o_orderdate"), F.lit("/"), F.year("o_orderdate"), F.lit(" 0:00"))
    return v.table("orders").select("o_orderkey", dates.year_of_slashed_date(shown).alias("y"))


@query("SELECT id, CAST(regexp_extract(src, '([0-9]{4})', 1) AS INT) AS y FROM detections")
def i6_map_year(v):
    return v("detections").select("id", dates.map_year(F.col("src")).alias("y"))


@query("SELECT id, round(sqrt(pow((x - 20000) * 0.5, 2) + pow((y - 7000) * 1.11, 2)), 6) AS d FROM registry_points")
def i13_planar_distance(v):
    return v("registry_points").select("id", F.round(geo.planar_m(F.lit(20_000) / 1e5, F.lit(7000) / 1e5, F.col("x") / 1e5, F.col("y") / 1e5), 6).alias("d"))


@query("SELECT id, round(0.4 * o + 0.3 * greatest(0.0, 1 - d / 20.0) + 0.2 * a + 0.1, 9) AS c FROM (SELECT p_partkey AS id, p_size / 50.0 AS o, p_size % 25 AS d, p_size % 10 / 10.0 AS a FROM part)")
def i18_match_confidence(v):
    size = F.col("p_size")
    return v.table("part").select(F.col("p_partkey").alias("id"), F.round(geo.match_confidence(size / 50.0, size % 25, size % 10 / 10.0, F.lit(1.0)), 9).alias("c"))


@query("SELECT id, 2 AS points, round(CAST(x1 AS DOUBLE), 3) AS last_x FROM roads")
def i22_from_wkt(v):
    wkt = F.concat(F.lit("LINESTRING ("), F.col("x0"), F.lit(" "), F.col("y0"), F.lit(", "), F.col("x1"), F.lit(" "), F.col("y1"), F.lit(")"))
    rows = v("roads").select("id", geo.points(geo.from_wkt(wkt)).alias("p"))
    return rows.select("id", F.size("p").alias("points"), F.round(F.element_at("p", -1)["x"], 3).alias("last_x"))


@query("SELECT building_id, seq, CAST(CASE WHEN o >= 0.7 THEN 0.9 WHEN o >= 0.5 THEN 0.8 WHEN o >= 0.3 OR d < 5 THEN 0.7 WHEN d < 10 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS c FROM (SELECT *, confidence AS o, source_id % 20 AS d FROM evidence)")
def j5_match_confidence(v):
    return v("evidence").select("building_id", "seq", evidence.match_confidence(F.col("confidence"), F.col("source_id") % 20).alias("c"))


@query("SELECT id, CASE WHEN d < 0.5 THEN 1870 WHEN d < 1 THEN 1900 WHEN d < 2 THEN 1930 WHEN d < 4 THEN 1960 ELSE 1975 END AS y FROM (SELECT id, sqrt(pow(x - 20000.0, 2) + pow(y - 7000.0, 2)) / 3000 AS d FROM registry_points)")
def j6_estimate_by_centre(v):
    d = F.sqrt(F.pow(F.col("x") - 20_000.0, 2) + F.pow(F.col("y") - 7000.0, 2)) / 3000
    return v("registry_points").select("id", evidence.estimate_by_centre(d)["year"].alias("y"))


@query("SELECT id, CAST(floor((1900 * a + 1950 * b) / (a + b)) AS INT) AS y FROM (SELECT p_partkey AS id, (p_size % 9 + 1) / 10.0 AS a, (p_size % 4 + 1) / 10.0 AS b FROM part)")
def j9_combine_estimates(v):
    size, one = F.col("p_size"), lambda y, c, m: F.struct(F.lit(y).alias("year"), c.alias("confidence"), F.lit(m).alias("method"))
    both = F.array(one(1900, (size % 9 + 1) / 10.0, "centre"), one(1950, (size % 4 + 1) / 10.0, "type"))
    return v.table("part").select(F.col("p_partkey").alias("id"), evidence.combine_estimates(both)["year"].alias("y"))


@query("SELECT ord AS building_id, CASE WHEN sd IS NULL THEN 'presence' ELSE 'exact' END AS evidence_type, sd AS exact_year, CAST(CASE WHEN sd IS NULL THEN 0.6 ELSE 0.85 END AS DOUBLE) AS confidence FROM base_features")
def j1_to_evidence(v):
    return evidence.osm_evidence(v("base_features").select(F.col("ord").alias("building_id"), F.lit(1).alias("source_id"), "sd", "ed")).select("building_id", "evidence_type", "exact_year", "confidence")


@query("SELECT p_partkey AS id, CASE WHEN p_type LIKE '%STEEL%' THEN 'h' ELSE 'm' END AS ev, 'keep' AS note FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'l', 'old' FROM part WHERE p_partkey % 2 = 1")
def a15_upsert(v):
    old = v.table("part").select(F.col("p_partkey").alias("id"), F.lit("l").alias("ev"), F.lit("old").alias("note"))
    new = v.table("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_type").contains("STEEL"), "h").otherwise("m").alias("ev"), F.lit("keep").alias("note"))
    return evidence.upsert(old, new, ["id"])


@query("SELECT id, CASE WHEN src LIKE '%1880' THEN 'kv1880' WHEN src LIKE '%1904' THEN 'kv1904' ELSE 'air1947' END AS ml_src, CAST(regexp_extract(src, '([0-9]{4})', 1) AS INT) AS sd, CASE WHEN confidence >= 0.9 THEN 'h' WHEN confidence >= 0.7 THEN 'm' ELSE 'l' END AS ev FROM detections")
def b16_normalize_ml(v):
    rows = v("detections").select("src", F.col("id").cast("string").alias("feature_id"), "confidence", F.lit("building").alias("class"), F.col("box").alias("geometry"))
    catalog = v.spark.createDataFrame([("ml_aerial_1947", 1947)], "src string, reference_year int")
    return normalize.normalize_ml(rows, catalog).select(F.regexp_extract("src_id", r"(\d+)$", 1).cast("long").alias("id"), "ml_src", "sd", "ev")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'agricultural' WHEN 2 THEN 'commercial' WHEN 3 THEN 'religious' WHEN 4 THEN 'ruin' END AS bt FROM orders")
def b11_building_type(v):
    names = F.array(*[F.lit(x) for x in ("Bolig", "Fjøs", "Fabrikk", "Kirke", "Tomt", "x")])
    k = F.col("o_orderkey")
    return v.table("orders").select(k.alias("id"), normalize.building_type(F.element_at(names, (k % 6 + 1).cast("int")), F.lit("999")).alias("bt"))
