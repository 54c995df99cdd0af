"""The pipeline's stages, each on what the one before it wrote."""

import collections
import os
import random
import re
import sys

import pytest

import corpus_pipeline
from chronofeat.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] and counts[4] == counts[5] > 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_narrow_margins_are_rejected(spark):
    rng = random.Random(4)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, letters in (("en", "abcdefghijk"), ("de", "klmnopqrstu"))}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, rng.randint(20, 90)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(500, "жщ", None), (501, " ".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(300)), None), (502, "12 - 34!", "en"), (503, None, "en"), (504, say("en", 20_000), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # equal sizes, a language that nothing was learned of and no letter go; a long text stays
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, table, "").collect()} == {*range(120), 504}


def test_names():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input, against plain Python over whole texts."""
    sys.path.insert(0, os.path.dirname(__file__))
    from test_operators import hit, joined, smallest

    from chronofeat.llm import langid, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = lambda df: {r.doc_id for r in df.collect()}
    stage = dict(corpus_pipeline.STAGES)
    # language ID: a letter, and a lead over the runner-up
    dictionaries = langid.train(docs.where(~langid.held_out()))
    rows = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    leads = smallest([r.text for r in rows], dictionaries, least=langid.FULL)
    docs_1 = stage["language_id"](spark, docs, SF)
    assert kept(docs_1) == {r.doc_id for r, (_, _, lead) in zip(rows, leads, strict=True) if lead >= corpus_pipeline.MARGIN}
    # near duplicates: the smallest id of each group
    plain = [(r.doc_id, r.text) for r in docs_1.collect()]
    docs_2 = stage["ngram_jaccard_join"](spark, docs_1, SF)
    assert kept(docs_2) == {k for k, _, c in joined(plain, 5, 80) if k == c}
    # benchmark passages
    plain = [(r.doc_id, r.text) for r in docs_2.collect()]
    docs_3 = stage["benchmark_decontamination"](spark, docs_2, SF)
    assert kept(docs_3) == {k for k, x in hit(plain, items).items() if not x[4]}
    # mixing: each source near its target, no document more than twice, all columns as they were
    before, after = docs_3.collect(), stage["source_mixing"](spark, docs_3, SF).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before}
    sources = sorted({r.source for r in before if r.source is not None}) + ([None] if any(r.source is None for r in before) else [])
    total = {s: sum(size[r.doc_id] for r in before if r.source == s) for s in sources}
    goal = dict(zip(sources, mixing.targets([total[s] for s in sources], [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sources))], 1.5, 2.0), strict=True))
    for s in sources:
        assert abs(sum(size[r.doc_id] for r in after if r.source == s) - goal[s]) <= max(size[r.doc_id] for r in before if r.source == s)
    times = collections.Counter(r.doc_id for r in after)
    assert max(times.values()) <= 2 and set(map(tuple, after)) <= set(map(tuple, before))
    # sharding: every row once, slots without gaps, equal texts together, no shard above the least possible size
    mixed = spark.createDataFrame(after, docs.schema)
    shards = stage["sharding"](spark, mixed, SF).collect()
    assert len(shards) == len(after)
    groups, of = collections.Counter(), collections.defaultdict(set)
    for r in shards:
        groups[r.text_crc32, r["size"]] += r["size"]
        of[r.shard].add(r.slot)
    assert all(slots == set(range(len(slots))) for slots in of.values()) and set(of) <= set(range(8))
    load = collections.Counter()
    for r in shards:
        load[r.shard] += r["size"]
    assert max(load.values()) <= sum(load.values()) / 8 + max(groups.values())
