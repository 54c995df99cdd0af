"""Record linkage: by key, by overlap, by centroid, by distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..lineage import cut
from . import copies, overlay, spatial


def link_by_ref(base: DataFrame, dates: DataFrame) -> DataFrame:
    """(did, ord, score 1) of date features that name a base feature."""
    return dates.where("osm_ref IS NOT NULL").join(base.select(F.col("fid").alias("osm_ref"), "ord"), "osm_ref").select("did", "ord", F.lit(1.0).alias("score"))


def link_by_overlap(a: DataFrame, b: DataFrame, threshold: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Pairs (a, b, score) whose polygons share that part of the smaller one; of tables without a column `geometry`, boxes.

    Boxes filter: their shared area bounds that of the polygons, which alone are read edge by edge.
    Rows without a polygon count by their box. Rings are taken as valid, holes as inside their part.
    """
    if not overlay.shaped(a, b):
        score = spatial.overlap_ratio(F.col("a.box"), F.col("b.box"))
        return spatial.box_join(a, b, cell).select("a", "b", score.alias("score")).where(F.col("score") >= threshold)
    found = overlay.pairs(a, b, cell, "_area").where((F.col("most") > 0) & (F.col("most") >= threshold * overlay.smaller()))
    found = found.withColumn("score", overlay.overlap_ratio(F.col("a.geometry"), F.col("b.geometry")))
    return overlay.plain(found.where(F.col("score") >= threshold), "score")


def linked_classes(a: DataFrame, b: DataFrame, keys: tuple[str, str], links: Callable[[DataFrame, DataFrame], DataFrame], *more: str) -> DataFrame:
    """(kind, a, b, measures) of a join of places over tables with copies; links(a, b) gives the keys a, b and measures of linked rows.
    more: columns beside the shape that copies have in common.

    Rows of kind `link` name the representatives, the smallest keys, of two classes of copies; those
    of kind `a` or `b` name a representative of that side and another key of its class. All pairs
    of rows follow from them: every member of one class is linked with every one of the other.
    """
    left, right = copies.classes(a, keys[0], *more), copies.classes(b, keys[1], *more)
    found = links(left, right)
    out = copies.with_members(found, a=copies.members(a, keys[0], left, *more), b=copies.members(b, keys[1], right, *more))
    return out.select("kind", *found.columns)


def linked_rows(a: DataFrame, b: DataFrame, keys: tuple[str, str], links: Callable[[DataFrame, DataFrame], DataFrame], *more: str) -> DataFrame:
    """(a, b, measures) of all pairs of rows that links(a, b) finds; as linked_classes, but with the pairs themselves.

    Classes of copies are judged once, and every row of one is then paired with every row of the other.
    """
    left, right = copies.classes(a, keys[0], *more), copies.classes(b, keys[1], *more)
    return copies.all_pairs(links(left, right), copies.rows_of(a, keys[0], left, *more), copies.rows_of(b, keys[1], right, *more))


def link_points(points: DataFrame, boxes: DataFrame, cell: float = 64.0) -> DataFrame:
    """Pairs (a, b, score 1) of points (a box without extent) in the interior of a polygon, or of a box in a table without polygons."""
    p, b = F.col("a.box"), F.col("b.box")
    inside = (p["x0"] > b["x0"]) & (p["x0"] < b["x1"]) & (p["y0"] > b["y0"]) & (p["y0"] < b["y1"])
    found = spatial.box_join(points, boxes, cell).where(inside)
    if overlay.shaped(boxes):
        found = found.where(F.coalesce(geo.strictly_inside(p["x0"], p["y0"], F.col("b.geometry")), F.lit(True)))
    return found.select("a", "b", F.lit(1.0).alias("score"))


def centre(b, axis: str):
    return (b[axis + "0"] + b[axis + "1"]) / 2


def holds_centre(a, b):
    """Whether box a strictly holds the centre of box b."""
    return (centre(b, "x") > a["x0"]) & (centre(b, "x") < a["x1"]) & (centre(b, "y") > a["y0"]) & (centre(b, "y") < a["y1"])


def link_by_centroid(a: DataFrame, b: DataFrame, cell: float = 64.0) -> DataFrame:
    """Pairs (a, b, score 1) of which one has the other's centre of gravity in its interior; boxes and their middles without polygons."""
    if overlay.shaped(a, b):
        at = lambda p, c: c["x"].between(p["box"]["x0"], p["box"]["x1"]) & c["y"].between(p["box"]["y0"], p["box"]["y1"])
        holds = lambda p, q: F.when(at(p, q["_centre"]), overlay.holds_centre(p, q)).otherwise(False)  # noqa: E731  edges are read only where the centre lies in the box
        found = overlay.pairs(a, b, cell, "_centre").where(holds(F.col("a"), F.col("b")) | holds(F.col("b"), F.col("a")))
        return overlay.plain(found.withColumn("score", F.lit(1.0)), "score")
    x, y = F.col("a.box"), F.col("b.box")
    return spatial.box_join(a, b, cell).where(holds_centre(x, y) | holds_centre(y, x)).select("a", "b", F.lit(1.0).alias("score"))


def attach_dates(base: DataFrame, dates: DataFrame, threshold: float = 0.5, cell: float = 64.0) -> DataFrame:
    """(did, ord): each date feature goes to the first base feature that it names or overlaps.

    A base feature may take any number. Taking the smallest ordinal of all candidates is what a
    pass over the base in order, that uses up each date feature once, comes to.
    """
    by_ref = link_by_ref(base, dates).select("did", "ord")
    shape = lambda df, key: df.select(key, *[c for c in ("box", "geometry") if c in df.columns])
    dates = shape(dates, "did")
    classes = copies.classes(dates, "did")
    pairs = link_by_overlap(classes, copies.classes(shape(base, "ord"), "ord"), threshold, cell)
    first = pairs.groupBy(F.col("a.copy").alias("copy")).agg(F.min("b.ord").alias("ord"))
    by_place = copies.marked(dates).select("did", "copy").join(first, "copy").select("did", "ord")
    return by_ref.union(by_place).groupBy("did").agg(F.min("ord").alias("ord"))


def unmatched(a: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Rows of a that no link names."""
    return a.join(links, key, "left_anti")


def best_match(a: DataFrame, b: DataFrame, least: float = 0.1, radius: float = 30.0, cell: float = 64.0, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(id, other, overlap, distance): of each row of a the best row of b, by overlap from `least` on, else the nearest centre under the radius.

    With a column `geometry` on a side, overlap is that of polygons and centres are centres of gravity.
    Ids are unique; rows of one shape are judged once.
    """
    apart = lambda p, q: F.sqrt(F.pow((p[0] - q[0]) * scale[0], 2) + F.pow((p[1] - q[1]) * scale[1], 2))
    margin = radius / min(scale)
    rows, a, b = a, copies.classes(a, "id"), copies.classes(b, "id")
    if overlay.shaped(a, b):
        found = overlay.pairs(a, b, cell, "_area", "_centre", margin=margin)
        middle = lambda c: (F.col(f"{c}._centre.x"), F.col(f"{c}._centre.y"))
        found = found.where((F.col("most") > 0) & (F.col("most") >= least * overlay.smaller()) | (apart(middle("a"), middle("b")) < radius))
        overlap = overlay.overlap_ratio(F.col("a.geometry"), F.col("b.geometry"))
    else:
        found = spatial.box_join(a, b.withColumn("own", F.col("box")).withColumn("box", spatial.widened(F.col("box"), margin)), cell)
        boxes = {"a": F.col("a.box"), "b": F.col("b.own")}
        middle = lambda c: (centre(boxes[c], "x"), centre(boxes[c], "y"))
        overlap = spatial.overlap_ratio(boxes["a"], boxes["b"])
    pairs = found.select(F.col("a.copy").alias("copy"), F.col("b.id").alias("other"), overlap.alias("overlap"), apart(middle("a"), middle("b")).alias("distance")).where((F.col("overlap") >= least) | (F.col("distance") < radius))
    good = F.when(F.col("overlap") >= least, F.col("overlap")).otherwise(-1.0)
    best = pairs.groupBy("copy").agg(F.min_by(F.struct("other", "overlap", "distance"), F.struct(-good, F.when(good < 0, F.col("distance")).otherwise(0.0), F.col("other"))).alias("m"))
    return copies.marked(rows).select("id", "copy").join(best, "copy").select("id", "m.*")


def duplicate_pairs(df: DataFrame, least: float = 0.8, cell: float = 64.0) -> DataFrame:
    """(a, b) ids, a < b, of rows whose polygons (boxes without a column `geometry`) have that intersection over union."""
    ids = (F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    if not overlay.shaped(df):
        pairs = spatial.box_join(df.select("id", "box"), df.select("id", "box"), cell).where("a.id < b.id")
        return pairs.where(spatial.iou(F.col("a.box"), F.col("b.box")) >= least).select(*ids)
    rows = df.select("id", "box", "geometry", *[c for c in overlay.MEASURES if c in df.columns])
    found = overlay.pairs(rows, rows, cell, "_area").where("a.id < b.id")
    found = found.where((F.col("most") > 0) & ((1 + least) * F.col("most") >= least * (F.col("a._area") + F.col("b._area"))))
    return found.withColumn("iou", overlay.iou(F.col("a.geometry"), F.col("b.geometry"))).where(F.col("iou") >= least).select(*ids)


def duplicate_classes(df: DataFrame, least: float = 0.8, cell: float = 64.0) -> DataFrame:
    """(kind, a, b): duplicates as links between representatives of copies, and the other ids of each class (kind `copy`); a < b in both.

    All duplicate_pairs follow: those of a linked pair of classes with one another, and those of a
    class among themselves. Shapes without area are nobody's duplicates.
    """
    df = _shapes(df)
    found = copies.classes(df, "id", area=True)
    return copies.with_members(duplicate_pairs(found, least, cell), copy=copies.members(df, "id", found)).select("kind", "a", "b")


def duplicate_rows(df: DataFrame, least: float = 0.8, cell: float = 64.0) -> DataFrame:
    """(a, b) as duplicate_pairs of the rows, copies among them; each class of copies is judged once. Shapes without area are nobody's duplicates."""
    df = _shapes(df)
    found = copies.classes(df, "id", area=True)
    itself = found.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return copies.pairs_among(duplicate_pairs(found, least, cell).union(itself), copies.rows_of(df, "id", found))


def _shapes(df: DataFrame) -> DataFrame:
    rows = df.select("id", *[c for c in ("rank", "box", "geometry") if c in df.columns])
    return overlay.with_shape(rows) if overlay.shaped(df) else rows


def duplicate_stars(df: DataFrame, least: float = 0.8, rank: str = "id", cell: float = 64.0) -> DataFrame:
    """(id, seed) as duplicate_groups makes them of duplicate_pairs of rows (id, box), ids unique, in the order of a rank that tells rows apart.

    Copies share the neighbours of the first of them and are its own, so they go where it goes:
    only representatives are compared and settled.
    """
    rows = _shapes(df.withColumn("rank", F.struct(rank, "id") if rank != "id" else F.struct("id")))
    found = copies.classes(rows.drop("id"), "rank", area=True)
    ranks = found.withColumnRenamed("rank", "id").drop("copy")
    seeds = duplicate_groups(ranks, duplicate_pairs(ranks, least, cell))
    seeds = found.select("rank", "copy").join(seeds.withColumnRenamed("id", "rank"), "rank").select("copy", F.col("seed.id").alias("seed"))
    seeds = copies.marked(rows).select("id", "copy").join(seeds, "copy").select("id", "seed")
    return df.select("id").distinct().join(seeds, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))


#: Links of a component that one task settles in turn; larger ones are settled in rounds.
LOCAL = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (a, b): the smallest node that each reaches.

    In a round each node points to its smallest neighbour, pointers are doubled until they end at
    roots, and the edges between roots are the next, smaller graph: half of its nodes go at least.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    label = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")))
        while True:
            point = cut(point.alias("p").join(point.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"), (F.col("to") != F.col("further")).alias("moved")))
            if point.where("moved").isEmpty():
                break
            point = point.select("node", "to")
        point = point.select("node", "to")
        label = point if label is None else cut(label.join(point.select(F.col("node").alias("to"), F.col("to").alias("root")), "to", "left").select("node", F.coalesce("root", "to").alias("to")))
        root = lambda c: point.select(F.col("node").alias(c), F.col("to").alias(f"root_{c}"))
        edges = cut(edges.join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.select("node", F.col("to").alias("component"))


def _take_in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that others take, of links (component, a, b) in that order: a free row takes its later neighbours."""
    plain = lambda c: list(zip(*(f.to_pylist() for f in c.flatten()), strict=True)) if pa.types.is_struct(c.type) else c.to_pylist()
    now, taken = None, set()
    for batch in batches:
        new = []
        for of, a, b in zip(*(plain(batch.column(c)) for c in ("component", "a", "b")), strict=True):
            if of != now:
                now, taken = of, set()
            new.append(a not in taken and b not in taken)
            if new[-1]:
                taken.add(b)
        yield pa.RecordBatch.from_arrays([batch.column("b").filter(pa.array(new, pa.bool_()))], ["id"])


def _chains(links: DataFrame) -> DataFrame:
    """(id, taken): rows whose one earlier neighbour, and that one's, and so on, lead to a row without any: every other one is free.

    Pointers along such rows are doubled, so that a chain takes rounds by the logarithm of its length.
    """
    one = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"), F.count("*").alias("n"))
    heads = links.select(F.col("a").alias("id")).join(one, "id", "left_anti").distinct().select("id", F.col("id").alias("to"), F.lit(0).alias("odd"))
    several = one.where("n > 1").select("id", F.lit(None).cast(links.schema["a"].dataType).alias("to"), F.lit(0).alias("odd"))
    state = cut(one.where("n = 1").select("id", "to", F.lit(1).alias("odd")).union(heads).union(several))
    while True:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("odd").alias("more"))
        moved = state.join(ahead, "to", "left").select("id", F.col("further").alias("to"), ((F.col("odd") + F.coalesce("more", F.lit(0))) % 2).alias("odd"), (~F.col("to").eqNullSafe(F.col("further"))).alias("moved"))
        state = cut(moved)
        if state.where("moved").isEmpty():
            return state.where("to IS NOT NULL").select("id", (F.col("odd") == 1).alias("taken"))
        state = state.drop("moved")


def taken_rows(links: DataFrame) -> DataFrame:
    """(id) of rows that an earlier row takes: in order, each row that is still free takes all its later neighbours. links (a, b) have a < b, each once."""
    found, kind = None, links.schema["a"].dataType.simpleString()
    while True:
        known = components(links)
        sized = known.join(links, known["node"] == links["a"]).select("component", "a", "b")
        sizes = sized.groupBy("component").agg(F.count("*").alias("n"))
        large = cut(sizes.where(F.col("n") > LOCAL).select("component"))  # each stands for over LOCAL links
        small = sized.join(large, "component", "left_anti").repartition("component").sortWithinPartitions("component", "a", "b")
        new = cut(small.mapInArrow(_take_in_turn, f"id {kind}"))
        found = new if found is None else found.union(new)
        if large.isEmpty():
            return found
        links = cut(sized.join(large, "component", "left_semi").select("a", "b"))
        settled = cut(_chains(links))
        free = settled.where("NOT taken").select(F.col("id").alias("a"))
        taken = cut(links.join(free, "a", "left_semi").select(F.col("b").alias("id")).union(settled.where("taken").select("id")).distinct())
        found = found.union(taken)
        gone = cut(taken.union(free.select(F.col("a").alias("id"))).distinct())
        links = cut(links.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti"))


def duplicate_groups(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, seed): stars around the first row: a row joins its smallest neighbour that is a seed itself; others are their own.

    pairs (a, b) have a < b. A row that no earlier row takes is a seed, also if its earlier
    neighbours all joined others. Chains may have any length: a component of up to LOCAL links is
    settled in turn in one task, link by link; of a larger one all chains at once, in rounds by the
    logarithm of their length, and what is left falls into components again.
    """
    links = cut(pairs.select("a", "b").distinct())
    taken = taken_rows(links)
    seeds = links.join(taken.select(F.col("id").alias("a")), "a", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("seed"))
    return df.select("id").distinct().join(seeds, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))


def enrich(df: DataFrame, other: DataFrame, key: str, *columns: str) -> DataFrame:
    """df with columns of the row of `other` that has its key (one at most), null without one."""
    return df.join(other.select(key, *columns), key, "left")


def enrich_by_number(roads: DataFrame, register: DataFrame, parts: tuple[str, ...], *columns: str) -> DataFrame:
    """Roads with columns of a register, met under the concatenation of category and number; null without an entry, or without one of the parts."""
    ref = F.concat(*[F.col(c).cast("string") for c in parts])
    return enrich(roads.withColumn("_ref", ref), register.withColumn("_ref", ref), "_ref", *columns).drop("_ref")


def building_at_point(points: DataFrame, boxes: DataFrame, radius: float, cell: float = 128.0) -> DataFrame:
    """(id, ord): of each point (id, x, y) the first polygon that holds it, else the nearest within the radius, ties to the smaller ord; null without one.

    Tables without a column `geometry` count by their boxes: the first that holds the point, else the nearest middle.
    """
    rows = points.select("id", spatial.at_point(F.col("x"), F.col("y")).alias("box"))
    at = copies.classes(rows, "id").withColumns({"x": F.col("box.x0"), "y": F.col("box.y0")})
    boxes = copies.classes(boxes.select("ord", *[c for c in ("box", "geometry") if c in boxes.columns]), "ord")
    inside = link_points(at, boxes, cell).groupBy(F.col("a.id").alias("id")).agg(F.min("b.ord").alias("ord"))
    rest = at.join(inside, "id", "left_anti")
    if overlay.shaped(boxes):
        shape = F.coalesce("geometry", geo.box(*(F.col(f"box.{c}") for c in ("x0", "y0", "x1", "y1"))))
        wide = rest.withColumn("box", spatial.widened(F.col("box"), radius))
        found = spatial.box_join(wide, boxes.select("ord", "box", shape.alias("geometry")), cell)
        near = found.select(F.col("a.id").alias("id"), F.col("b.ord").alias("ord"), geo.distance_to(F.col("a.x"), F.col("a.y"), F.col("b.geometry")).alias("distance")).where(F.col("distance") <= radius)
    else:
        centres = boxes.select("ord", centre(F.col("box"), "x").alias("x"), centre(F.col("box"), "y").alias("y"))
        near = spatial.within_distance(rest, centres, radius).select(F.col("a.id").alias("id"), F.col("b.ord").alias("ord"), "distance")
    near = near.groupBy("id").agg(F.min_by("ord", F.struct("distance", "ord")).alias("ord"))
    first = at.join(inside.union(near), "id").select("copy", "ord")
    return copies.marked(rows).select("id", "copy").join(first, "copy", "left").select("id", "ord")
