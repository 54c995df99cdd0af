"""Readers of large collections, page series, manifests and folders on small files."""

import json

import pytest

from chronofeat.functions import geo
from chronofeat.sources import readers, sinks


def feature(i, shape="Point"):
    at = {"Point": [i, i + 0.5], "LineString": [[i, 0], [i, 1]]}[shape]
    return {"type": "Feature", "properties": {"id": i, "text": 'a "quoted" {brace} ]}, ' * (i % 5)}, "geometry": {"type": shape, "coordinates": at}}


def plain(df):
    return sorted((r.properties["id"], r.properties["text"], r.geometry.gtype, [tuple(p) for part in r.geometry.parts for ring in part for p in ring]) for r in df.collect())


@pytest.mark.parametrize("bytes_", [700, 4096, 1 << 27])
def test_large_collection_is_split(spark, tmp_path, bytes_):
    """One line of one file, read by many tasks, gives the same rows for any split."""
    features = [feature(i, "LineString" if i % 3 else "Point") for i in range(400)]
    features[7]["geometry"] = None
    whole = {"type": "FeatureCollection", "name": "x", "features": features}
    (tmp_path / "a.geojson").write_text(json.dumps(whole, separators=(",", ":")))
    (tmp_path / "b.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    try:
        found = readers.read_large_geojson(spark, str(tmp_path))
        assert (found.rdd.getNumPartitions() > 10) == (bytes_ < 1 << 20)
        assert plain(found) == plain(readers.read_geojson(spark, str(tmp_path))) and found.count() == 399
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_page_series(spark, tmp_path):
    """A series ends with its first short page, before a missing one, or after the page that takes it over the cap."""
    pages = {"a-0": 3, "a-1": 3, "a-2": 2, "a-3": 3, "b-1": 3, "b-3": 3, "c-9": 3, "c-10": 3, "c-11": 3, "c-12": 3, "d-0": 1, "e-0": 0, "e-1": 3}
    for name, n in pages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps([{"page": name} for _ in range(n)]))
    read = lambda **x: sorted({r.page for r in readers.read_pages(spark, f"{tmp_path}/*.json", "page string", **x).collect()})
    assert read(size=3) == ["a-0", "a-1", "a-2", "b-1", "c-10", "c-11", "c-12", "c-9", "d-0", "e-1"]
    assert read(size=3, cap=5) == ["a-0", "a-1", "b-1", "c-10", "c-9", "d-0", "e-1"]
    assert len(read()) == 12
    again = readers.read_pages(spark, str(tmp_path), "page string", size=3)
    assert "FileScan json" not in again._jdf.queryExecution().executedPlan().toString()  # the files were read once, for the sizes and the rows
    assert sorted({r.page for r in again.collect()}) == read(size=3)


def test_manifests_and_folders(spark, tmp_path):
    for folder, body in (("x", {"source_id": "s1", "record_count": 3}), ("x/y", {"source_id": "s2"}), ("z", {"record_count": 1})):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "manifest.json").write_text(json.dumps(body))
    (tmp_path / "x" / "other.json").write_text('{"source_id": "no"}')
    assert sorted((r.source_id, r.record_count, r.path.rsplit("/", 1)[1]) for r in readers.discover_sources(spark, str(tmp_path)).collect()) == [("s1", 3, "x"), ("s2", None, "y")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "map.1880.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1), feature(2)]}))
    (tmp_path / "in" / "one.json").write_text(json.dumps(feature(3)))
    found = readers.read_dir_with_source(spark, str(tmp_path / "in"))
    assert sorted((r.src, r.properties["id"]) for r in found.collect()) == [("map.1880", "1"), ("map.1880", "2"), ("one", "3")]
    assert found.schema["geometry"].dataType.simpleString() == geo.GEOMETRY


def test_tasks_name_documents(spark, tmp_path):
    """Documents stand under their names without a file that the driver lists or renames."""
    rows = spark.createDataFrame([(f"n{k % 3}/s{k}/manifest", json.dumps({"source_id": f"s{k}\u00e6", "record_count": k})) for k in range(50)] + [("plain name", "{}")], "name string, value string")
    sinks.write_documents(rows, str(tmp_path / "out"), ".json")
    assert {str(f.relative_to(tmp_path / "out")) for f in (tmp_path / "out").rglob("*") if f.is_file()} == {f"n{k % 3}/s{k}/manifest.json" for k in range(50)} | {"plain name.json"}
    assert sorted((r.source_id, r.record_count, r.path.rsplit("/", 2)[1]) for r in readers.discover_sources(spark, f"file://{tmp_path}/out").collect()) == sorted((f"s{k}\u00e6", k, f"n{k % 3}") for k in range(50))
    sinks.write_documents(rows.limit(0), f"file://{tmp_path}/none", ".json")
    assert (tmp_path / "none").is_dir()
