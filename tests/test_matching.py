"""Matches and merges that SQL cannot express, against plain loops over the same tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofeat.operators import lines, link, matching, merge, sets
from chronofeat.plans import further, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def stars(ranks, pairs):
    """Each free row, in the order of rank, takes its own free neighbours."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seed = {}
    for x in sorted(ranks, key=ranks.get):
        if x not in seed:
            seed[x] = x
            for y in near.get(x, ()):
                seed.setdefault(y, x)
    return seed


def test_groups_of_whole_table(spark):
    rows, pairs = further._mergeable(registry.Views(spark, SF))
    table = {r.id: r for r in rows.select("id", "priority", "src", "gtype", "sd", "ev").collect()}
    links = [tuple(r) for r in pairs.collect()]
    found = registry.queries()["h8_duplicate_groups"](spark, SF).collect()
    assert {r.id: r.seed for r in found} == stars({x: x for x in table}, links) and len(found) == len(table)
    seed = stars({x: (r.priority, x) for x, r in table.items()}, links)
    members = {}
    for x, s in seed.items():
        members.setdefault(s, []).append(table[x])
    merged = registry.queries()["f4_greedy_merge"](spark, SF).collect()
    assert len(merged) == len(members)
    for r in merged:
        own = sorted(members[r.seed], key=lambda m: (m.priority, m.id))
        assert r.n == len(own) and r.sources == ",".join(sorted({m.src for m in own}))
        assert r.sd == next((m.sd for m in own if m.sd is not None), None)
        assert r.ev == min((m.ev for m in own), key="hml".index)
        assert r.geometry_of == min(own, key=lambda m: (0 if m.src == "manual" else 1 if m.gtype == "Polygon" else 2, m.id)).id


def test_groups_of_chains(spark):
    rng = random.Random(3)
    ids = list(range(40))
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(30)} | {(k, k + 1) for k in range(20, 35)})
    found = link.duplicate_groups(spark.createDataFrame([(x,) for x in ids], "id long"), spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.seed for r in found.collect()} == stars({x: x for x in ids}, pairs)
    none = link.duplicate_groups(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "a long, b long"))
    assert [tuple(r) for r in none.collect()] == [(1, 1)]


def line(points):
    return ("LineString", [[[{"x": float(x), "y": float(y)} for x, y in points]]])


POINT = "struct<x:double,y:double>"


def test_road_links(spark):
    roads = {1: ("Kirkegata", [(0, 0), (100, 0)]), 2: ("kirkegata ", [(0, 5), (100, 5)]), 3: ("Elvegata", [(0, 8), (100, 9)]), 4: (None, [(0, 60), (100, 60)]), 5: ("Kirkegata", [(0, 0), (100, 0), (100, 300)])}
    rows = [(k, nm, line(p), (float(min(x for x, _ in p)), float(min(y for _, y in p)), float(max(x for x, _ in p)), float(max(y for _, y in p)))) for k, (nm, p) in roads.items()]
    df = spark.createDataFrame(rows, f"id long, nm string, geometry struct<gtype:string,parts:array<array<array<{POINT}>>>>, box struct<x0:double,y0:double,x1:double,y1:double>")
    expected = {}
    for a, (na, p) in roads.items():
        for b, (nb, q) in roads.items():
            one, two = (lines.Lines(*np.array(g, float).T, np.array([0, len(g)])) for g in (p, q))
            far = lines.hausdorff(one, two)[0]
            if a != b and far <= 20:
                same = na and nb and na.strip().lower() == nb.strip().lower()
                score = 0.4 * lines.buffer_shares(one, two, 10.0)[0] + 0.3 * (1 - far / 20) + (0.3 if same else 0.0)
                if score >= 0.3:
                    expected[a, b] = round(min(1.0, score), 9)
    found = matching.link_roads(df, df).collect()
    assert {(r.id, r.other): round(r.score, 9) for r in found} == expected and expected
    for r in found:
        assert r["rank"] == 1 + sum((s > r.score - 1e-12 and b < r.other or s > round(r.score, 9)) for (a, b), s in expected.items() if a == r.id and b != r.other)


def test_even_sample(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    order = [r.id for r in df.orderBy("k").collect()]
    assert [r.id for r in sets.even_sample(df.repartition(5), 50, "k").collect()] == order[::20]
    assert sets.even_sample(df.limit(0), 5, "k").count() == 0


def test_reconcile_and_gaps(spark):
    rows = [(1, "osm", "g1", 0.5, 1900, None, None), (1, "sefrak", "g2", 0.9, 1850, None, None), (2, "map", "g3", 0.7, None, None, 1880), (2, "map", "g4", 0.8, None, None, 1904), (3, "osm", "g5", None, None, 1950, None)]
    found = {r.id: r for r in merge.reconcile(spark.createDataFrame(rows, "id long, src string, geometry string, geometry_confidence double, sd int, ed int, map_year int")).collect()}
    assert (found[1].geometry, found[1].sd, found[1].ed, found[1].origin.start_date) == ("g2", 1850, None, "sefrak")
    assert (found[2].geometry, found[2].sd, found[2].ed, found[2].origin.end_date) == ("g4", 1880, 1904, "map")
    assert (found[3].sd, found[3].ed) == (None, None)


@pytest.mark.parametrize("local", [1_000_000, 20])
def test_groups_of_chains_and_random_graphs(spark, monkeypatch, local):
    """In turn in one task, and in rounds where components are larger than that."""
    monkeypatch.setattr(link, "LOCAL", local)
    rng = random.Random(1)
    perm = rng.sample(range(1000, 1300), 300)
    pairs = [(i, i + 1) for i in range(700)] + [tuple(sorted(x)) for x in zip(perm, perm[1:], strict=False)]
    pairs += [tuple(sorted(rng.sample(range(2000, 2200), 2))) for _ in range(400)]
    df = spark.range(2300)
    found = link.duplicate_groups(df, spark.createDataFrame([*pairs, pairs[0]], "a long, b long"))
    assert {r.id: r.seed for r in found.collect()} == stars({x: x for x in range(2300)}, pairs)
    assert {(r.id, r.seed) for r in link.duplicate_groups(spark.range(3), spark.createDataFrame([], "a long, b long")).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_components_of_a_chain(spark):
    found = link.components(spark.createDataFrame([*[(i, i + 1) for i in range(500)], (900, 901), (905, 901), (7, 7)], "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {**dict.fromkeys(range(501), 0), 900: 900, 901: 900, 905: 900}
