"""Feature views derived from the given tables by integer arithmetic.

The SQL below is read alike by Spark and by DuckDB, so that oracle queries start from the same
rows. Places are whole units of 1e-5 degrees; x0, y0, x1 and y1 are the corners of a box.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo

#: View name to (tables, SQL).
VIEWS = {
    "base_features": (
        ("orders",),
        """SELECT o_orderkey AS ord, concat('way/', CAST(o_orderkey AS STRING)) AS fid, CASE WHEN o_orderkey % 9 = 4 THEN 'matrikkelen' ELSE 'osm' END AS src,
            CAST(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE year(o_orderdate) - 20 * (o_orderkey % 13) END AS INT) AS sd,
            CAST(CASE WHEN o_orderkey % 11 = 3 THEN year(o_orderdate) - 20 * (o_orderkey % 13) + 30 + o_orderkey % 40 END AS INT) AS ed,
            CASE o_orderstatus WHEN 'F' THEN 'h' WHEN 'P' THEN 'm' ELSE 'l' END AS ev,
            (o_orderkey * 7919) % 40000 AS x0, (o_orderkey * 104729) % 15000 AS y0,
            (o_orderkey * 7919) % 40000 + 40 + o_orderkey % 7 * 20 AS x1, (o_orderkey * 104729) % 15000 + 40 + o_orderkey % 5 * 20 AS y1
        FROM orders""",
    ),
    "date_features": (
        ("lineitem",),
        """SELECT l_orderkey * 8 + l_linenumber AS did, CASE WHEN l_linenumber % 2 = 1 THEN concat('way/', CAST(l_orderkey AS STRING)) END AS osm_ref,
            CASE l_returnflag WHEN 'N' THEN 'manual' WHEN 'A' THEN 'finn' ELSE 'sefrak' END AS src,
            CAST(year(l_shipdate) - 20 * (l_orderkey % 13) - l_linenumber AS INT) AS sd, CASE WHEN l_quantity > 35 THEN 'h' WHEN l_quantity > 15 THEN 'm' ELSE 'l' END AS ev,
            (l_orderkey * 7919) % 40000 + l_linenumber * 13 - 20 AS x0, (l_orderkey * 104729) % 15000 + l_linenumber * 11 - 20 AS y0,
            (l_orderkey * 7919) % 40000 + l_linenumber * 13 + 30 AS x1, (l_orderkey * 104729) % 15000 + l_linenumber * 11 + 25 AS y1
        FROM lineitem""",
    ),
    "registry_points": (
        ("customer",),
        """SELECT c_custkey AS id, (c_custkey * 7919) % 40000 + 25 AS x, (c_custkey * 104729) % 15000 + 20 AS y, CAST(1700 + c_custkey % 250 AS INT) AS sd,
            CASE c_custkey % 3 WHEN 0 THEN 'h' WHEN 1 THEN 'm' ELSE 'l' END AS ev, CASE WHEN c_custkey % 5 = 0 THEN 'sefrak' ELSE 'osm' END AS sd_src, c_mktsegment AS kind
        FROM customer""",
    ),
    "roads": (
        ("part",),
        """SELECT p_partkey AS id, p_name AS nm, CASE p_partkey % 4 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' WHEN 2 THEN 'footway' ELSE 'historical' END AS rt,
            CAST(CASE WHEN p_partkey % 3 = 0 THEN 1800 + p_size * 4 END AS INT) AS sd, CAST(CASE WHEN p_partkey % 7 = 0 THEN 1800 + p_size * 4 + 60 END AS INT) AS ed,
            CASE p_partkey % 3 WHEN 0 THEN 'h' WHEN 1 THEN 'm' ELSE 'l' END AS ev, CASE WHEN p_partkey % 4 = 3 THEN 'ml' ELSE 'nvdb' END AS src,
            CASE WHEN p_partkey % 4 = 3 THEN concat('kv', CAST(1880 + p_partkey % 3 * 24 AS STRING)) END AS ml_src,
            (p_partkey * 7919) % 40000 AS x0, (p_partkey * 104729) % 15000 AS y0, (p_partkey * 7919) % 40000 + p_size * 9 + 10 AS x1, (p_partkey * 104729) % 15000 + p_size * 5 AS y1
        FROM part""",
    ),
    "evidence": (
        ("lineitem",),
        """SELECT l_orderkey AS building_id, l_suppkey AS source_id, l_linenumber AS seq,
            CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'N' THEN 'presence' WHEN 'A' THEN 'absence' ELSE 'range' END ELSE CASE WHEN l_linenumber % 3 = 0 THEN 'exact' ELSE 'presence' END END AS evidence_type,
            CAST(year(l_shipdate) - 120 - l_linenumber * 7 AS INT) AS min_year, CAST(year(l_shipdate) - 20 * (l_linenumber % 5) AS INT) AS max_year, CAST(year(l_shipdate) - 60 - l_linenumber AS INT) AS exact_year,
            CAST(CASE WHEN l_quantity > 45 THEN year(l_shipdate) + 5 END AS INT) AS end_year, l_quantity / 50.0 AS confidence
        FROM lineitem""",
    ),
    "evidence_sources": (("supplier",), "SELECT s_suppkey AS source_id, s_name AS source_name, CAST(s_suppkey * 7 % 23 AS INT) AS priority FROM supplier"),
    "detections": (
        ("part",),
        """SELECT p_partkey AS id, (p_partkey * 7919) % 40000 + p_size % 30 AS x0, (p_partkey * 104729) % 15000 + p_size % 20 AS y0, (p_partkey * 7919) % 40000 + 60 + p_size AS x1,
            (p_partkey * 104729) % 15000 + 50 + p_size AS y1, CAST(p_size AS DOUBLE) / 50 AS confidence, CASE p_partkey % 3 WHEN 0 THEN 'ml_kartverket_1880' WHEN 1 THEN 'ml_aerial_1947' ELSE 'ml_kartverket_1904' END AS src
        FROM part""",
    ),
    "raw_dates": (
        ("orders",),
        """SELECT o_orderkey AS id, CASE o_orderkey % 12
            WHEN 0 THEN CAST(1650 + o_orderkey % 400 AS STRING) WHEN 1 THEN concat('ca ', CAST(1700 + o_orderkey % 300 AS STRING)) WHEN 2 THEN concat(CAST(1700 + o_orderkey % 300 AS STRING), '-05-17')
            WHEN 3 THEN concat(CAST(1700 + o_orderkey % 200 AS STRING), ' - ', CAST(1910 + o_orderkey % 90 AS STRING)) WHEN 4 THEN concat(CAST(170 + o_orderkey % 30 AS STRING), '0s')
            WHEN 5 THEN concat(CASE o_orderkey % 5 WHEN 0 THEN 'early ' WHEN 1 THEN 'MID ' ELSE 'late ' END, CAST(170 + o_orderkey % 30 AS STRING), '0s') WHEN 6 THEN concat(CAST(17 + o_orderkey % 5 AS STRING), 'th century')
            WHEN 7 THEN concat(CAST(16 + o_orderkey % 5 AS STRING), '00-tallet') WHEN 8 THEN concat(' built about ', CAST(1500 + o_orderkey % 600 AS STRING), ' or so') WHEN 9 THEN CASE o_orderkey % 2 WHEN 0 THEN 'Middelalder' ELSE 'jernaldergrav' END
            WHEN 10 THEN 'unknown' END AS value
        FROM orders""",
    ),
    "class_pairs": (
        ("documents", "labels"),
        "SELECT d.doc_id AS id, l.quality AS truth, CASE WHEN d.n_chars % 3 = 0 THEN 1 - l.quality ELSE l.quality END AS pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "edits": (
        ("events",),
        "SELECT event_id, user_id AS fid, ts AS edited_at, CAST(1800 + floor(value) % 220 AS INT) AS sd, event_type AS note FROM events WHERE event_type IN ('view', 'purchase', 'click')",
    ),
}

#: Views of boxes with a notch (n0, m0, n1, m1) cut out: none, one that is open to the top, or a hole, in turn.
SHAPED = {"base_shapes": ("base_features", "ord"), "date_shapes": ("date_features", "did"), "detection_shapes": ("detections", "id")}
for _name, (_of, _key) in SHAPED.items():
    VIEWS[_name] = (VIEWS[_of][0], f"SELECT *, x0 + 10 AS n0, CASE WHEN {_key} % 3 = 0 THEN x0 + 10 ELSE x1 - 10 END AS n1, y0 + 15 AS m0, CASE {_key} % 3 WHEN 0 THEN y0 + 15 WHEN 1 THEN y1 ELSE y1 - 10 END AS m1 FROM ({VIEWS[_of][1]}) f")


def notched() -> Column:
    """The polygon of a row with a box and a notch."""
    at = lambda *names: F.array(*[geo.point(F.col(x), F.col(y)) for x, y in names])
    whole = at(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))
    hole = at(("n0", "m0"), ("n1", "m0"), ("n1", "m1"), ("n0", "m1"), ("n0", "m0"))
    bay = at(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("n1", "y1"), ("n1", "m0"), ("n0", "m0"), ("n0", "y1"), ("x0", "y1"), ("x0", "y0"))
    rings = F.when(F.col("n0") == F.col("n1"), F.array(whole)).when(F.col("m1") == F.col("y1"), F.array(bay)).otherwise(F.array(whole, hole))
    return F.struct(F.lit("Polygon").alias("gtype"), F.array(rings).alias("parts"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view over the tables in sf_dir; views with corners also have them as the struct `box`."""
    tables, sql = VIEWS[name]
    found = spark.sql(sql.replace("FROM " + tables[0], "FROM {" + tables[0] + "}").replace("JOIN " + tables[-1], "JOIN {" + tables[-1] + "}"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
    found = found.withColumn("geometry", notched()) if name in SHAPED else found
    return found.withColumn("box", F.struct("x0", "y0", "x1", "y1")) if "x1" in found.columns else found


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
