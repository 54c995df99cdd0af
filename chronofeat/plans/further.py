"""Registered queries of matches, merges, estimates, common rows and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geo
from ..operators import evidence, filters, link, matching, merge, reports, resolve, sets, spatial
from ..sources import features
from .registry import ESTIMATE, FEATURE, OVERLAP, TOUCH, _base_boxes, _estimates, _holds, _lines, query

CENTRES = "sqrt(pow((a.x0 + a.x1 - b.x0 - b.x1) / 2.0, 2) + pow((a.y0 + a.y1 - b.y0 - b.y1) / 2.0, 2))"
PLACE = f"CASE WHEN {_holds('a', 'b')} OR {_holds('b', 'a')} THEN 0.8 WHEN {CENTRES} < 20 THEN 0.6 ELSE 0 END"
SHIFT = "b.x0 + 4 AS x0, b.y0 + 3 AS y0, b.x1 + 4 AS x1, b.y1 + 3 AS y1"

# ---------------------------------------------------------------- scans and common rows


@query("SELECT ord, fid, src, sd, ed, ev FROM base_features WHERE src = 'osm' AND sd IS NOT NULL AND sd >= 1850 AND sd <= 1899")
def a10_scan(v):
    return filters.scan(v("base_features"), FEATURE, sources=["osm"], dated=True, low=1850, high=1899)


@query("""SELECT fid AS src_id, concat('{"_src":"base","_src_id":"', fid, '"', CASE WHEN sd IS NULL THEN '' ELSE concat(',"sd":', CAST(sd AS VARCHAR)) END, CASE WHEN ed IS NULL THEN '' ELSE concat(',"ed":', CAST(ed AS VARCHAR)) END, ',"ev":"', ev, '","nm":"', src, '"}') AS props FROM base_features""")
def b1_to_feature(v):
    rows = v("base_features").select(F.col("fid").alias("src_id"), "sd", "ed", F.when(F.col("ev") != "l", F.col("ev")).alias("ev"), F.lit(" ").alias("bt"), F.col("src").alias("nm"), F.col("box").alias("geometry"))
    return features.to_feature(rows, "base").select("src_id", "props")


@query("""SELECT concat('r-', CAST(id AS VARCHAR)) AS src_id, concat('{"_src":"nvdb","_src_id":"r-', CAST(id AS VARCHAR), '"', CASE WHEN sd IS NULL THEN '' ELSE concat(',"sd":', CAST(sd AS VARCHAR)) END, CASE WHEN ed IS NULL THEN '' ELSE concat(',"ed":', CAST(ed AS VARCHAR)) END,
    ',"ev":"', ev, '","rt":"', rt, '","len":', CAST(x1 - x0 AS VARCHAR), '.5,"nvdb_id":', CAST(id AS VARCHAR), '}') AS props FROM roads""")
def b2_to_road_feature(v):
    rows = v("roads").select(F.concat(F.lit("r-"), F.col("id")).alias("src_id"), "sd", "ed", "ev", "rt", (F.col("x1") - F.col("x0") + 0.45 + 0.01).alias("len"), F.col("id").alias("nvdb_id"), F.col("box").alias("geometry"))
    return features.to_road_feature(rows, "nvdb").select("src_id", "props")


@query("""SELECT concat('kult_', CAST(p_partkey AS VARCHAR)) AS src_id, CAST(CASE WHEN p_size % 4 = 0 THEN 1700 + p_size WHEN p_size % 4 = 1 THEN 1800 + p_size WHEN p_size % 4 = 2 THEN 1000 + p_size END AS INT) AS sd,
    CASE WHEN p_size % 7 <> 0 THEN p_name END AS nm, CASE p_size % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'path' WHEN 3 THEN 'track' ELSE 'historical' END AS rt, least(500, length(concat('laid in ', CASE WHEN p_size % 4 = 3 THEN 'x' ELSE '' END, CAST(1000 + p_size AS VARCHAR), repeat(' stone', p_size * 3)))) AS told
    FROM part WHERE p_size % 6 <> 0""")
def b19_normalize_heritage(v):
    size, line = F.col("p_size"), F.when(F.col("p_size") % 6 == 0, "Point").otherwise("LineString")
    kinds = F.element_at(F.array(*map(F.lit, ("Gammel Kongevei", "postvei", "Ferdselsåre", "sti", "bro"))), (size % 5 + 1).cast("int"))
    rows = v.table("part").select(
        F.col("p_partkey").alias("id"), F.when(size % 7 == 0, "  ").otherwise(F.col("p_name")).alias("navn"), F.when(size % 4 == 0, (1700 + size).cast("string")).alias("datering"), F.when(size % 4 == 1, F.concat(F.lit("ca "), 1800 + size)).alias("byggeår"),
        F.when(size % 4 < 3, F.concat(F.lit("laid in "), 1000 + size, F.repeat(F.lit(" stone"), size * 3))).otherwise(F.concat(F.lit("laid in x"), 1000 + size, F.repeat(F.lit(" stone"), size * 3))).alias("beskrivelse"), kinds.alias("art"), F.struct(line.alias("gtype")).alias("geometry"),
    )
    return features.normalize_heritage(rows).select("src_id", "sd", "nm", "rt", F.char_length("description").cast("long").alias("told"))


@query("""SELECT o_orderkey AS id, CAST(s AS INT) AS start_date, CAST(e AS INT) AS end_date, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 1.0 END AS confidence FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1650 + o_orderkey % 500 WHEN 1 THEN 1700 + o_orderkey % 300 WHEN 2 THEN 1750 + o_orderkey % 250 END AS y, CASE WHEN o_orderkey % 5 = 0 THEN 1900 + o_orderkey % 150 END AS e0 FROM orders), LATERAL (SELECT CASE WHEN y BETWEEN 1700 AND 2099 THEN y ELSE 1900 END AS s, e0 AS e)
    WHERE (e IS NULL OR s <= e) AND s <= 2025 AND (e IS NULL OR e <= 2035)""")
def b23_normalize_any(v):
    k = F.col("o_orderkey")
    rows = v.table("orders").select(k.alias("id"), F.when(k % 4 == 0, (1650 + k % 500).cast("string")).when(k % 4 == 2, F.concat(F.lit("about "), 1750 + k % 250, F.lit("?"))).when(k % 4 == 1, "unknown").alias("start_date"), F.when(k % 4 == 1, 1700 + k % 300).alias("year"), F.when(k % 5 == 0, 1900 + k % 150).alias("end_year"), F.when(k % 3 == 0, 0.5).alias("confidence"))
    return features.normalize_any(rows, "osm", 2025, default_start=1900).select("id", "start_date", "end_date", "confidence")


@query("""SELECT bid, CASE WHEN p IS NOT NULL THEN 'sef' WHEN source = 'sefrak' THEN 'sef' WHEN source = 'matrikkelen' THEN 'mat' WHEN source = 'ml_1880_matched' THEN 'ml' WHEN source IN ('osm', 'osm_assumed', 'ml_1880_not_detected') THEN 'osm' ELSE 'unk' END AS src, CASE WHEN p IS NOT NULL OR strong THEN 'h' ELSE 'l' END AS ev,
    CAST(coalesce(p, CASE WHEN strong THEN coalesce(y, CASE WHEN source = 'ml_1880_matched' THEN 1880 END) END) AS INT) AS sd, CASE WHEN source = 'ml_1880_matched' THEN 0.8 END AS mlc
    FROM (SELECT *, source IN ('sefrak', 'matrikkelen', 'ml_1880_matched') OR (source = 'osm' AND y IS NOT NULL) AS strong FROM (SELECT o_orderkey AS bid, CASE o_orderkey % 6 WHEN 0 THEN 'sefrak' WHEN 1 THEN 'osm' WHEN 2 THEN 'ml_1880_matched' WHEN 3 THEN 'ml_1880_not_detected' WHEN 4 THEN 'finn' ELSE 'osm_assumed' END AS source,
        CASE WHEN o_orderkey % 5 < 3 THEN 1750 + o_orderkey % 200 END AS y, CASE WHEN o_orderkey % 11 = 0 THEN 1700 + o_orderkey % 100 END AS p FROM orders))""")
def b25_to_evidence_schema(v):
    k = F.col("o_orderkey")
    source = F.element_at(F.create_map(*[F.lit(x) for kv in enumerate(("sefrak", "osm", "ml_1880_matched", "ml_1880_not_detected", "finn")) for x in kv]), (k % 6).cast("int"))
    rows = v.table("orders").select(k.alias("osm_id"), source.alias("source"), F.when(k % 5 < 3, F.concat(1750 + k % 200, F.lit("-05-17"))).alias("start_date"), F.when(k % 11 == 0, F.concat(1700 + k % 100, F.lit(" - 1850"))).otherwise("unknown").alias("sefrak_period"), F.lit(None).cast("double").alias("ml_confidence"), F.lit("yes").alias("building"), F.lit("").alias("name"))
    return features.to_evidence_schema(rows).select("bid", "src", "ev", "sd", "mlc")


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_size % 6 IN (0, 1) THEN 3 WHEN p_size % 6 = 2 THEN 1 WHEN p_size % 6 = 3 THEN 2 WHEN p_size % 6 = 4 THEN 4 ELSE 0 END AS INT) AS cls FROM part")
def b32_classify_tags(v):
    tag = lambda *kv: F.create_map(*map(F.lit, kv))
    tags = F.element_at(F.array(tag("waterway", "stream", "building", "yes"), tag("natural", "water"), tag("building", "yes", "highway", "path"), tag("highway", "path", "landuse", "forest"), tag("landuse", "forest"), tag("natural", "rock")), (F.col("p_size") % 6 + 1).cast("int"))
    return v.table("part").select(F.col("p_partkey").alias("id"), features.classify_tags(tags).alias("cls"))


# ---------------------------------------------------------------- matches


@query(f"""SELECT id, other, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS n FROM (SELECT a.id, b.ord AS other, CAST({PLACE} AS DOUBLE) AS score FROM detections a JOIN base_features b ON {TOUCH}) WHERE score >= 0.5) WHERE n = 1""")
def d10_match_detections(v):
    return matching.match_detections(v("detections"), _base_boxes(v))


@query(f"""SELECT id, other, overlap_score, round(combined, 6) AS combined, CASE WHEN combined >= 0.7 THEN 'high' WHEN combined >= 0.5 THEN 'medium' ELSE 'low' END AS quality FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(combined, 9) DESC, other) AS n FROM (
    SELECT id, other, CAST(s AS DOUBLE) AS overlap_score, 0.4 * confidence + 0.3 * s + 0.16 + 0.1 * greatest(0.0, 1 - d / 20.0) AS combined FROM (SELECT a.ord AS id, b.id AS other, b.confidence, {PLACE} AS s, {CENTRES} AS d FROM base_features a JOIN detections b ON a.x0 <= b.x1 + 20 AND b.x0 - 20 <= a.x1 AND a.y0 <= b.y1 + 20 AND b.y0 - 20 <= a.y1) WHERE s > 0) WHERE combined >= 0.3) WHERE n = 1""")
def d12_verify_match(v):
    found = matching.verify_match(_base_boxes(v), v("detections"))
    return found.select("id", "other", "overlap_score", F.round("combined", 6).alias("combined"), "quality")


@query()
def d13_link_roads(v):
    """Roads against the same roads drawn three units off, as links between classes of one course and name, with their ranks, and the other roads of each class; the share of surroundings has no SQL, tests hold it against the kernels."""
    roads = _lines(v, "true").join(v("roads").select("id", "nm"), "id")
    moved = F.struct((F.col("box.x0") + 3).alias("x0"), F.col("box.y0").alias("y0"), (F.col("box.x1") + 3).alias("x1"), F.col("box.y1").alias("y1"))
    shape = F.struct("geometry.gtype", F.transform("geometry.parts", lambda p: F.transform(p, lambda r: F.transform(r, lambda q: geo.point(q["x"] + 3, q["y"])))).alias("parts"))
    again = roads.select((F.col("id") + 1_000_000_000).alias("id"), "nm", shape.alias("geometry"), moved.alias("box"))
    links = lambda a, b: matching.link_roads(a, b).select(F.col("id").alias("a"), F.col("other").alias("b"), F.round("score", 6).alias("score"), "rank")
    return link.linked_classes(roads, again, ("id", "id"), links, "nm")


_SEG = "(a.x{0} - b.x0) * CAST(vx AS DOUBLE) + (a.y{0} - b.y0) * vy"


@query(f"""WITH b AS (SELECT id, nm, rt, x0 + 2 AS x0, y0 + 1 AS y0, x1 + 2 AS x1, y1 + 1 AS y1, x1 - x0 AS vx, y1 - y0 AS vy FROM roads), a AS (SELECT *, x1 - x0 AS ux, y1 - y0 AS uy FROM roads WHERE src = 'ml'),
    p AS (SELECT a.id, b.id AS other, b.nm, b.rt, ux, uy, vx, vy, CAST(ux * ux + uy * uy AS DOUBLE) AS uu, CAST(vx * vx + vy * vy AS DOUBLE) AS vv, {_SEG.format(0)} AS s, {_SEG.format(1)} AS e, (a.x0 + a.x1) / 2.0 - b.x0 AS mx, (a.y0 + a.y1) / 2.0 - b.y0 AS my FROM a JOIN b ON a.x0 - 5 <= b.x1 AND b.x0 <= a.x1 + 5 AND a.y0 - 5 <= b.y1 AND b.y0 <= a.y1 + 5),
    q AS (SELECT *, least(greatest((mx * vx + my * vy) / vv, 0.0), 1.0) AS m FROM p), d AS (SELECT *, sqrt(pow(mx - m * vx, 2) + pow(my - m * vy, 2)) AS distance FROM q),
    r AS (SELECT id, other, nm, rt, (least(1.0, greatest(0.0, least(greatest(s / vv, e / vv), 1.0) - greatest(least(s / vv, e / vv), 0.0)) * sqrt(vv) / sqrt(uu)) + abs(ux * vx + uy * vy) / sqrt(uu * vv) + greatest(0.0, 1 - distance / 5.0)) / 3 AS score FROM d WHERE distance <= 5),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS n FROM r WHERE score > 0.6)
    SELECT a.id, k.nm, coalesce(k.rt, 'unknown') AS rt, round(k.score, 6) AS score FROM a LEFT JOIN k ON k.id = a.id AND k.n = 1""")
def d23_inherit_road_attrs(v):
    moved = v("roads").select("id", "nm", "rt", (F.col("x0") + 2).alias("x0"), (F.col("y0") + 1).alias("y0"), (F.col("x1") + 2).alias("x1"), (F.col("y1") + 1).alias("y1"))
    return matching.inherit_road_attrs(v("roads").where("src = 'ml'"), moved).select("id", "nm", "rt", F.round("score", 6).alias("score"))


def _far(p: str, q: str) -> str:
    return ", ".join(
        f"CASE WHEN greatest({q}.x0 - {p}.x{i}, 0, {p}.x{i} - {q}.x1) > 0 OR greatest({q}.y0 - {p}.y{j}, 0, {p}.y{j} - {q}.y1) > 0 THEN sqrt(pow(greatest({q}.x0 - {p}.x{i}, 0, {p}.x{i} - {q}.x1), 2) + pow(greatest({q}.y0 - {p}.y{j}, 0, {p}.y{j} - {q}.y1), 2)) ELSE CAST(least({p}.x{i} - {q}.x0, {q}.x1 - {p}.x{i}, {p}.y{j} - {q}.y0, {q}.y1 - {p}.y{j}) AS DOUBLE) END"
        for i in (0, 1) for j in (0, 1)
    )


AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"


@query(f"""WITH a AS (SELECT did, x0, y0, x1, y1 FROM date_features), b AS (SELECT did, {SHIFT} FROM date_features b), p AS (SELECT a.did AS id, b.did AS other, {OVERLAP} / CAST({AREA.format('a')} + {AREA.format('b')} - {OVERLAP} AS DOUBLE) AS iou, greatest({_far('a', 'b')}, {_far('b', 'a')}) AS hausdorff, {AREA.format('a')} AS area_a, {AREA.format('b')} AS area_b FROM a JOIN b ON {TOUCH})
    SELECT id, other, round(iou, 9) AS iou, round(hausdorff, 6) AS hausdorff FROM p WHERE iou > 0.5 AND hausdorff < 10 AND area_a > 0.5 * area_b AND area_a < 2 * area_b""")
def d24_chain_match(v):
    """A slice of features against the next one, drawn (4, 3) off."""
    first = v("date_features").select(F.col("did").alias("id"), "box")
    box = F.col("box")
    second = first.select("id", F.struct((box["x0"] + 4).alias("x0"), (box["y0"] + 3).alias("y0"), (box["x1"] + 4).alias("x1"), (box["y1"] + 3).alias("y1")).alias("box"))
    links = lambda a, b: matching.chain_match(a, b).select(F.col("id").alias("a"), F.col("other").alias("b"), F.round("iou", 9).alias("iou"), F.round("hausdorff", 6).alias("hausdorff"))
    return link.linked_rows(first, second, ("id", "id"), links).withColumnsRenamed({"a": "id", "b": "other"})


@query("""WITH s AS (SELECT b.ord AS id, d.did % 4 AS tile, count(*) AS pixels, avg(CASE WHEN d.ev <> 'l' THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT did, ev, (x0 + x1) / 2.0 AS x, (y0 + y1) / 2.0 AS y FROM date_features) d JOIN base_features b ON d.x BETWEEN b.x0 AND b.x1 AND d.y BETWEEN b.y0 AND b.y1 GROUP BY 1, 2)
    SELECT id, tile, pixels, round(share, 6) AS share, share >= 0.3 AS existed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, pixels DESC, tile) AS n FROM s) WHERE n = 1""")
def d21_footprint_overlap(v):
    pixels = v("date_features").select((F.col("did") % 4).alias("tile"), link.centre(F.col("box"), "x").alias("x"), link.centre(F.col("box"), "y").alias("y"), (F.col("ev") != "l").alias("on"))
    return matching.footprint_overlap(_base_boxes(v), pixels).select("id", "tile", "pixels", F.round("share", 6).alias("share"), "existed")


@query("""WITH t AS (SELECT DISTINCT CAST(floor(x / 1000) AS BIGINT) AS col, CAST(floor(y / 1000) AS BIGINT) AS row FROM registry_points)
    SELECT b.ord AS id, t.col * 100 + t.row AS tile FROM base_features b JOIN t ON (b.x0 + b.x1) / 2.0 >= t.col * 1000 AND (b.x0 + b.x1) / 2.0 < (t.col + 1) * 1000 AND (b.y0 + b.y1) / 2.0 >= t.row * 1000 AND (b.y0 + b.y1) / 2.0 < (t.row + 1) * 1000""")
def d20_features_to_tiles(v):
    at = v("registry_points").select(F.floor(F.col("x") / 1000).alias("col"), F.floor(F.col("y") / 1000).alias("row")).distinct()
    tiles = at.select((F.col("col") * 100 + F.col("row")).alias("tile"), *[(F.col(c) * 1000).alias(n) for c, n in (("col", "x0"), ("row", "y0"))], *[((F.col(c) + 1) * 1000).alias(n) for c, n in (("col", "x1"), ("row", "y1"))])
    return matching.features_to_tiles(_base_boxes(v), tiles.select("tile", F.struct("x0", "y0", "x1", "y1").alias("box")))


@query(f"""SELECT id, other, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS INT) AS rank FROM (SELECT a.id, b.ord AS other, {OVERLAP} / CAST(least({AREA.format('a')}, {AREA.format('b')}) AS DOUBLE) AS score FROM detections a JOIN base_features b ON {TOUCH}) WHERE score >= 0.2""")
def g3_rank_matches(v):
    found = matching.ranked_by_overlap(v("detections").select("id", "box"), v("base_features").select(F.col("ord").alias("id"), "box"), 0.2)
    return found.select("id", "other", F.round("score", 9).alias("score"), "rank")


@query("SELECT ord, src FROM base_features ORDER BY CASE src WHEN 'matrikkelen' THEN 4 WHEN 'osm' THEN 6 ELSE 999 END, ord")
def g1_by_priority(v):
    catalog = v.spark.createDataFrame([("matrikkelen", 4), ("osm", 6)], "src string, priority int")
    return sets.by_priority(v("base_features"), catalog, "ord").select("ord", "src")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) WHERE k % greatest(1, n // 200) = 0 ORDER BY o_orderkey LIMIT 200")
def g7_even_sample(v):
    return sets.even_sample(v.table("orders").select("o_orderkey"), 200, "o_orderkey")


# ---------------------------------------------------------------- merges


def _mergeable(v):
    rows = v("date_features").select(F.col("did").alias("id"), F.element_at(F.create_map(*[F.lit(x) for kv in (("manual", 0), ("finn", 1), ("sefrak", 2)) for x in kv]), F.col("src")).alias("priority"), "src", F.when(F.col("ev") == "l", "Point").otherwise("Polygon").alias("gtype"), "sd", F.lit(None).cast("int").alias("ed"), "ev", "box")
    rows = sets.dedup_keep_first(rows, "id", "priority", "sd", "ev")  # some ids stand for several rows
    return rows, link.duplicate_pairs(rows, 0.3)


def _stars_sql(rank: str) -> str:
    """Rows in the order of a rank, each free one taking its later neighbours: pairs, components by reachability, and the links of a component folded in turn."""
    return f"""WITH RECURSIVE d0 AS (SELECT *, CASE src WHEN 'manual' THEN 0 WHEN 'finn' THEN 1 ELSE 2 END AS priority FROM date_features),
        d AS (SELECT *, row_number() OVER (ORDER BY {rank}) AS k FROM (SELECT *, row_number() OVER (PARTITION BY did ORDER BY priority, sd, ev) AS n FROM d0) WHERE n = 1),
        p AS (SELECT least(a.k, b.k) AS a, greatest(a.k, b.k) AS b FROM d a JOIN d b ON {TOUCH} AND a.did < b.did WHERE {OVERLAP} >= 0.3 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {OVERLAP})),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT DISTINCT a AS node, a AS reach FROM e UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.node),
        c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
        t AS (SELECT component, list_reduce(list([a, b] ORDER BY a, b), lambda taken, l: CASE WHEN list_contains(taken, l[1]) OR list_contains(taken, l[2]) THEN taken ELSE list_append(taken, l[2]) END, []) AS taken FROM p JOIN c ON c.node = p.a GROUP BY component),
        s AS (SELECT p.b, min(p.a) AS a FROM p JOIN c ON c.node = p.a JOIN t ON t.component = c.component WHERE NOT list_contains(t.taken, p.a) GROUP BY p.b),
        g AS (SELECT d.*, coalesce(f.did, d.did) AS seed FROM d LEFT JOIN s ON s.b = d.k LEFT JOIN d f ON f.k = s.a) """


@query(_stars_sql("priority, did") + """SELECT seed, CAST(min_by(sd, k) AS INT) AS sd, CASE max(CASE ev WHEN 'h' THEN 3 WHEN 'm' THEN 2 ELSE 1 END) WHEN 3 THEN 'h' WHEN 2 THEN 'm' ELSE 'l' END AS ev, string_agg(DISTINCT src, ',' ORDER BY src) AS sources, count(*) AS n,
    CAST(min_by(did, CASE WHEN src = 'manual' THEN 0 WHEN ev <> 'l' THEN 1 ELSE 2 END * 1000000000000 + did) AS BIGINT) AS geometry_of FROM g GROUP BY seed""")
def f4_greedy_merge(v):
    """Date features merged by overlap in the order of priority."""
    rows, _ = _mergeable(v)
    return merge.merge_stars(rows, link.duplicate_stars(rows, 0.3, "priority"), "manual").select("seed", "sd", "ev", F.array_join("src_all", ",").alias("sources"), "n", "geometry_of")


@query(_stars_sql("did") + "SELECT did AS id, seed FROM g")
def h8_duplicate_groups(v):
    """Groups of duplicates around their first row, and single rows."""
    rows, _ = _mergeable(v)
    return link.duplicate_stars(rows, 0.3)


@query(_stars_sql("did") + """SELECT seed, CAST(min(sd) AS INT) AS sd, max(CAST(did % 97 AS DOUBLE) / 100) AS confidence, CAST(max_by(x0, did % 97 * 1000000000000 - did) AS BIGINT) AS x0, string_agg(DISTINCT src, ',' ORDER BY src) AS sources, count(*) AS n FROM g GROUP BY seed HAVING count(*) > 1""")
def e16_fold_duplicates(v):
    """Groups of duplicates folded into one row."""
    rows, _ = _mergeable(v)
    groups = link.duplicate_stars(rows, 0.3)
    members = rows.join(groups, "id").withColumn("confidence", (F.col("id") % 97).cast("double") / 100)
    folded = resolve.merge_group(members).where("n > 1")
    return folded.select("seed", "sd", "confidence", F.col("box.x0").alias("x0"), F.array_join("src_all", ",").alias("sources"), "n")


@query("SELECT did // 8 AS ord, CAST(min_by(did, CASE WHEN src = 'manual' THEN 0 WHEN ev <> 'l' THEN 1 ELSE 2 END * 1000000000000 + did) AS BIGINT) AS geometry_of FROM date_features GROUP BY 1")
def f5_pick_geometry(v):
    rows = v("date_features").select(F.col("did").alias("id"), F.floor(F.col("did") / 8).alias("ord"), "src", F.when(F.col("ev") == "l", "Point").otherwise("MultiPolygon").alias("gtype"))
    return merge.pick_geometry(rows, "ord", "manual")


@query("""WITH m AS (SELECT l_partkey AS id, l_orderkey * 8 + l_linenumber AS rank, CASE l_returnflag WHEN 'N' THEN 'osm' ELSE 'ml' END AS src, CAST(CASE WHEN l_linenumber % 3 = 0 THEN year(l_shipdate) - 100 END AS INT) AS sd, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS nm, CASE WHEN l_quantity > 45 THEN 'h' WHEN l_quantity > 25 THEN 'm' ELSE 'l' END AS ev FROM lineitem),
    f AS (SELECT id, min_by(sd, CASE WHEN sd IS NOT NULL THEN rank END) AS sd, min_by(nm, CASE WHEN nm IS NOT NULL THEN rank END) AS nm, max(CASE ev WHEN 'h' THEN 3 WHEN 'm' THEN 2 ELSE 1 END) AS ev, list(DISTINCT src) AS srcs FROM m GROUP BY id)
    SELECT r.id, coalesce(r.sd, f.sd) AS sd, coalesce(CASE WHEN r.id % 5 > 0 THEN r.nm END, f.nm) AS nm, CASE greatest(CASE r.ev WHEN 'h' THEN 3 WHEN 'm' THEN 2 ELSE 1 END, coalesce(f.ev, 0)) WHEN 3 THEN 'h' WHEN 2 THEN 'm' ELSE 'l' END AS ev, array_to_string(list_sort(list_distinct(list_concat([r.src], coalesce(f.srcs, [])))), ',') AS sources FROM roads r LEFT JOIN f ON f.id = r.id""")
def f6_merge_road_attrs(v):
    none = F.lit(None).cast("long").alias("nvdb_id")
    base = v("roads").select("id", "src", "sd", F.when(F.col("id") % 5 > 0, F.col("nm")).alias("nm"), "ev", none)
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    found = v.table("lineitem").select(
        F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 8 + n).alias("rank"), F.when(F.col("l_returnflag") == "N", "osm").otherwise("ml").alias("src"), F.when(n % 3 == 0, F.year("l_shipdate") - 100).alias("sd"), F.when(n % 2 == 0, F.col("l_returnflag")).alias("nm"), F.when(q > 45, "h").when(q > 25, "m").otherwise("l").alias("ev"), none
    )
    return merge.merge_road_attrs(base, found).select("id", "sd", "nm", "ev", F.array_join("src_all", ",").alias("sources"))


@query("""SELECT o.id, o.sd, CAST(coalesce(n.x0, o.x0) AS BIGINT) AS gx, coalesce(n.nm, o.nm) AS nm, round(CASE WHEN n.id IS NOT NULL THEN o.id % 7 / 7.0 END, 3) AS match_score, CASE WHEN n.id IS NOT NULL THEN CASE WHEN o.id % 2 = 0 THEN 'same' ELSE 'widened' END END AS change, CASE WHEN n.id IS NULL OR n.src = o.src THEN o.src ELSE 'ml,nvdb' END AS sources
    FROM (SELECT * FROM roads WHERE src = 'ml') o LEFT JOIN (SELECT * FROM roads WHERE src = 'nvdb') n ON n.id = o.id + 1 AND o.id % 3 > 0""")
def f7_apply_road_matches(v):
    roads = v("roads").withColumn("geometry", F.col("x0"))
    old = roads.where("src = 'ml'")
    k = F.col("id")
    matches = old.where("id % 3 > 0").select("id", (k + 1).alias("other"), (k % 7 / 7.0).alias("lss"), F.lit(1.234).alias("hausdorff"), F.when(k % 2 == 0, "same").otherwise("widened").alias("change"))
    out = merge.apply_road_matches(old, roads.where("src = 'nvdb'"), matches)
    return out.select("id", "sd", F.col("geometry").alias("gx"), "nm", "match_score", "change", F.array_join("src_all", ",").alias("sources"))


@query("SELECT p_partkey AS id, CAST(CASE p_size % 4 WHEN 0 THEN 1880 WHEN 1 THEN 1904 WHEN 2 THEN 1880 END AS INT) AS sd_map FROM part")
def f9_date_from_maps(v):
    size, y = F.col("p_size") % 4, F.lit(1900)
    years = F.when(size == 0, F.create_map(F.lit("ml_kartverket_1880"), y, F.lit("sefrak_1700"), y)).when(size == 1, F.create_map(F.lit("ml_kartverket_1904"), y)).when(size == 2, F.create_map(F.lit("ml_aerial_1947"), y, F.lit("ml_kartverket_1880"), y)).otherwise(F.create_map(F.lit("osm"), y))
    return resolve.date_from_maps(v.table("part").select(F.col("p_partkey").alias("id"), years.alias("years"))).select("id", "sd_map")


@query("""WITH r AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'N' THEN 'map' WHEN 'A' THEN 'sefrak' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'matrikkelen' ELSE 'osm' END END AS src, l_orderkey * 8 + l_linenumber AS geometry, l_quantity * 100 + l_linenumber AS conf, CAST(CASE WHEN l_returnflag <> 'N' AND l_linenumber % 3 > 0 THEN year(l_shipdate) - 150 END AS INT) AS sd,
        CAST(CASE WHEN l_linenumber = 5 THEN 1990 END AS INT) AS ed, CAST(CASE WHEN l_returnflag = 'N' THEN 1880 + l_linenumber * 10 END AS INT) AS map_year FROM lineitem),
    g AS (SELECT id, geometry FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, src) AS n FROM r) WHERE n = 1),
    s AS (SELECT id, sd FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE src WHEN 'sefrak' THEN 1 ELSE 2 END, sd) AS n FROM r WHERE sd IS NOT NULL AND src IN ('sefrak', 'matrikkelen')) WHERE n = 1),
    a AS (SELECT id, min(map_year) AS first_map, max(map_year) AS last_map, max(CASE WHEN src <> 'osm' THEN ed END) AS ed, bool_or(src = 'osm') AS stands FROM r GROUP BY id)
    SELECT a.id, g.geometry, coalesce(s.sd, first_map) AS sd, coalesce(ed, CASE WHEN NOT stands THEN last_map END) AS ed FROM a JOIN g ON g.id = a.id LEFT JOIN s ON s.id = a.id""")
def j12_reconcile(v):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    rows = v.table("lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(flag == "N", "map").when(flag == "A", "sefrak").when(n % 2 == 0, "matrikkelen").otherwise("osm").alias("src"), (F.col("l_orderkey") * 8 + n).alias("geometry"), (F.col("l_quantity") * 100 + n).alias("geometry_confidence"),
        F.when((flag != "N") & (n % 3 > 0), F.year("l_shipdate") - 150).alias("sd"), F.when(n == 5, 1990).alias("ed"), F.when(flag == "N", 1880 + n * 10).alias("map_year"),
    )
    return merge.reconcile(rows).select("id", "geometry", "sd", "ed")


# ---------------------------------------------------------------- estimates


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size * 40 > 500 THEN 1950 ELSE 1920 END WHEN p_size % 5 = 1 THEN 1800 WHEN p_size % 5 = 2 THEN 1970 WHEN p_size % 5 = 3 AND p_size * 40 > 1000 THEN 1960 END AS INT) AS year, CAST(CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size * 40 > 500 THEN 0.4 ELSE 0.3 END WHEN p_size % 5 = 1 THEN 0.25 WHEN p_size % 5 = 2 THEN 0.5 WHEN p_size % 5 = 3 AND p_size * 40 > 1000 THEN 0.35 ELSE 0 END AS DOUBLE) AS confidence FROM part")
def j7_estimate_by_type(v):
    kind = F.element_at(F.array(*map(F.lit, ("Warehouse", "chapel", "parking deck", "Residential", "shed"))), (F.col("p_size") % 5 + 1).cast("int"))
    return v.table("part").select(F.col("p_partkey").alias("id"), evidence.estimate_by_type(kind, F.col("p_size") * 40).alias("e")).select("id", "e.year", "e.confidence")


@query("""SELECT id, CAST(trunc(round(wy / w, 6)) AS INT) AS year, round(least(0.6, w / n * 0.5), 6) AS confidence, n AS neighbours FROM (SELECT a.id, sum(b.sd * (0.4 + b.id % 3 * 0.2) * (1 - d / 300.0)) AS wy, sum((0.4 + b.id % 3 * 0.2) * (1 - d / 300.0)) AS w, count(*) AS n
    FROM (SELECT a.id, b.id AS bid, sqrt(pow(CAST(a.x - b.x AS DOUBLE), 2) + pow(CAST(a.y - b.y AS DOUBLE), 2)) AS d FROM registry_points a JOIN registry_points b ON abs(a.x - b.x) <= 300 AND abs(a.y - b.y) <= 300) p JOIN registry_points a ON a.id = p.id JOIN registry_points b ON b.id = p.bid WHERE d <= 300 AND d > 1 GROUP BY a.id) WHERE w > 0""")
def j8_estimate_by_neighbours(v):
    points = v("registry_points")
    donors = points.select("id", "x", "y", F.col("sd").alias("year"), (0.4 + F.col("id") % 3 * 0.2).alias("confidence"))
    return evidence.estimate_by_neighbours(points, donors).select("id", "year", F.round("confidence", 6).alias("confidence"), "neighbours")


@query(ESTIMATE.replace("SELECT d.building_id,", ", est AS (SELECT d.building_id,", 1) + ") SELECT b.ord AS building_id, CASE WHEN b.src = 'matrikkelen' THEN est.start_year END AS est_start_year, CASE WHEN b.src = 'matrikkelen' THEN est.method END AS est_method FROM base_features b LEFT JOIN est ON est.building_id = b.ord")
def j3_recompute_matched(v):
    buildings = v("base_features").select(F.col("ord").alias("building_id"), "src")
    matched = buildings.where("src = 'matrikkelen'").select("building_id")
    return evidence.recompute(buildings, v("evidence"), v("evidence_sources"), 2025, matched).select("building_id", "est_start_year", "est_method")


@query("SELECT p_partkey AS id, round(0.4 * (p_size / 50.0) + 0.2 * (p_size % 3 / 3.0) + 0.2 * (p_size % 4 / 4.0) + 0.2 * (p_size % 5 / 5.0), 9) AS confidence FROM part")
def j11_extraction_confidence(v):
    size = F.col("p_size")
    return v.table("part").select(F.col("p_partkey").alias("id"), F.round(evidence.extraction_confidence(size / 50.0, size % 3 / 3.0, size % 4 / 4.0, size % 5 / 5.0), 9).alias("confidence"))


# ---------------------------------------------------------------- reports


@query("""WITH f AS (SELECT ord, src, sd, ed, ev, CASE WHEN ord % 10 = 1 THEN concat('kv', CAST(1880 + ord % 2 * 24 AS VARCHAR)) END AS ml_src, ord % 4 = 0 AS several FROM base_features), e AS (SELECT 'source' AS part, src AS name, count(*) AS n FROM f GROUP BY src UNION ALL SELECT 'evidence', ev, count(*) FROM f GROUP BY ev UNION ALL SELECT 'map', ml_src, count(*) FROM f WHERE ml_src IS NOT NULL GROUP BY ml_src
    UNION ALL SELECT 'all', 'n', count(*) FROM f UNION ALL SELECT 'all', 'start', count(sd) FROM f UNION ALL SELECT 'all', 'end', count(ed) FROM f UNION ALL SELECT 'all', 'several', count(CASE WHEN several THEN 1 END) FROM f UNION ALL SELECT 'all', 'replaced', 0 FROM (SELECT 1))
    SELECT part, name, n, round(100.0 * n / (SELECT count(*) FROM f), 1) AS pct FROM e UNION ALL SELECT 'years', 'first', min(sd), NULL FROM f UNION ALL SELECT 'years', 'last', max(sd), NULL FROM f""")
def e8_export_stats(v):
    k = F.col("ord")
    rows = v("base_features").select("src", "sd", "ed", "ev", F.when(k % 10 == 1, F.concat(F.lit("kv"), 1880 + k % 2 * 24)).alias("ml_src"), F.when(k % 4 == 0, F.array(F.lit("osm"), F.lit("ml"))).alias("src_all"))
    return reports.export_stats(rows)


@query("SELECT src, count(*) AS n, count(sd) AS dated FROM roads GROUP BY src")
def e9_road_export_stats(v):
    return reports.road_export_stats(v("roads"))


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN lss >= 0.8 AND h <= 10 AND w THEN 'widened' WHEN lss >= 0.8 AND h <= 10 THEN 'same' WHEN e AND lss >= 0.3 THEN 'rerouted' ELSE 'replaced' END AS change FROM (SELECT p_size % 11 / 10.0 AS lss, p_size % 17 AS h, p_size % 2 = 0 AS w, p_size % 3 = 0 AS e FROM part)) GROUP BY change")
def e13_change_counts(v):
    size = F.col("p_size")
    rows = v.table("part").select((size % 11 / 10.0).alias("lss"), (size % 17).alias("hausdorff"), (size % 2 == 0).alias("width_change"), (size % 3 == 0).alias("same_ends"))
    return reports.change_counts(resolve.classify_change(rows))


@query("SELECT how, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM roads), 1) AS pct FROM (SELECT CASE WHEN ev = 'h' AND sd IS NOT NULL THEN 'kept' WHEN sd IS NOT NULL THEN 'overridden' WHEN ml_src IS NOT NULL THEN 'map' ELSE 'none' END AS how FROM roads) GROUP BY how")
def e14_inference_stats(v):
    how = F.when((F.col("ev") == "h") & F.col("sd").isNotNull(), "kept").when(F.col("sd").isNotNull(), "overridden").when(F.col("ml_src").isNotNull(), "map")
    return reports.inference_stats(v("roads").withColumn("sd_how", how))


@query("SELECT CASE WHEN sd IS NULL THEN 'undated' WHEN sd < 1850 THEN 'before 1850' WHEN sd < 1900 THEN '1850-1899' WHEN sd < 1950 THEN '1900-1949' WHEN sd < 1980 THEN '1950-1979' ELSE '1980 on' END AS era, count(*) AS n FROM base_features GROUP BY 1")
def e6_count_by_era5(v):
    return reports.count_by_era(v("base_features"), 5)


@query("SELECT kind, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM registry_points), 1) AS pct FROM registry_points GROUP BY kind")
def e29_distribution(v):
    return reports.distribution(v("registry_points"), "kind")


# ---------------------------------------------------------------- scalar functions that other queries only reach


@query("SELECT ord, ord % 2 = 0 AS near FROM base_features")
def i15_boxes_meet(v):
    a, b = F.col("box"), F.struct((F.col("box.x1") + 5).alias("x0"), F.col("box.y0").alias("y0"), (F.col("box.x1") + 9).alias("x1"), F.col("box.y1").alias("y1"))
    return v("base_features").select("ord", F.when(F.col("ord") % 2 == 0, geo.boxes_meet(a, b, 5.0)).otherwise(geo.boxes_meet(a, b, 1.0)).alias("near"))


@query("SELECT p.id, b.ord FROM registry_points p JOIN base_features b ON p.x > b.x0 AND p.x < b.x1 AND p.y > b.y0 AND p.y < b.y1")
def i17_point_in_polygon(v):
    points = v("registry_points").select("id", spatial.at_point(F.col("x"), F.col("y")).alias("box"))

    def links(a, b):
        pairs = spatial.box_join(a, b.withColumn("geometry", geo.box(*(F.col(f"box.{c}").cast("double") for c in ("x0", "y0", "x1", "y1")))), 64.0)
        x, y = F.col("a.box.x0"), F.col("a.box.y0")
        inside = geo.point_in_polygon(x.cast("double"), y.cast("double"), F.col("b.geometry")) & (x > F.col("b.box.x0")) & (x < F.col("b.box.x1")) & (y > F.col("b.box.y0")) & (y < F.col("b.box.y1"))
        return pairs.where(inside).select(F.col("a.id").alias("a"), F.col("b.ord").alias("b"))

    return link.linked_rows(points, v("base_features").select("ord", "box"), ("id", "ord"), links).withColumnsRenamed({"a": "id", "b": "ord"})


@query("SELECT o_orderkey AS id, CASE WHEN y < 1800 THEN 'before 1800' WHEN y < 1850 THEN '1800-1849' WHEN y < 1900 THEN '1850-1899' WHEN y < 1950 THEN '1900-1949' WHEN y < 2000 THEN '1950-1999' ELSE '2000 on' END AS era FROM (SELECT o_orderkey, 1750 + o_orderkey % 300 AS y FROM orders)")
def i10_era6(v):
    return v.table("orders").select(F.col("o_orderkey").alias("id"), dates.era(1750 + F.col("o_orderkey") % 300, 6).alias("era"))


@query("SELECT l_orderkey, l_linenumber, l_discount >= 0.08 AS high, CASE WHEN l_discount >= 0.08 THEN 'h' WHEN l_discount >= 0.03 THEN 'm' ELSE 'l' END AS ev FROM lineitem")
def i11_evidence_of_confidence(v):
    from ..functions import text

    ev = text.evidence_from_confidence(F.col("l_discount"), 0.08, 0.03)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", text.meets(ev, "h").alias("high"), ev.alias("ev"))
