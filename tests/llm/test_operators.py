"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from chronofeat.llm import decontaminate, html_extract, langid, media, mixing, ngram_join, sharding, suffix_dedup, token_count, url_filter
from chronofeat.llm.graph import connected_components

UP = str.maketrans({c: c + 32 for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, block int, shard int, spans string"


def documents(seed=5, n=60):
    """Texts with copies, near copies, shared passages, nulls, empty and one-word texts, a long one, and a repeated row."""
    rng = random.Random(seed)
    words = ["the", "of", "Über", "ñandú", "a", "in", "that", "x1", "Ée", "zero", "ion", "tre", "ed", "ing", "st", "re", "and", "on"]
    say = lambda k: " ".join(rng.choice(words) + rng.choice(words) for _ in range(k))
    texts = [say(rng.randint(1, 120)) for _ in range(n)]
    texts += [texts[0], texts[1], texts[1], None, None, "", "", " \t\n", "Word", "word", "two words", say(4000)]
    for k in (5, 6, 7, 8):  # near copies, one word changed or added
        w = (texts[k] + " " + say(80)).split()
        texts[k] = " ".join(w)
        texts.append(" ".join([*w[:-1], "changed"]))
        texts.append(" ".join([*w, "more"]))
    passage = say(40)
    texts += [say(9) + "\n" + passage + "\n" + say(12) for _ in range(6)]
    rows = [(3 * i + 1, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", None]), None, "n", "k", 1, 2, "s") for i, t in enumerate(texts)]
    return [*rows, rows[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1: n-gram join


def components(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def joined(rows, n, num):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(UP))
        sets[r[0]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    where = components(sets, links)
    return {(k, len(s), where[k]) for k, s in sets.items()}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_join_is_exact(docs, n, num):
    found = ngram_join.near_duplicates(docs, words=n, num=num, den=100).collect()
    assert len(found) == docs.count()
    assert {tuple(r) for r in found} == joined(documents(), n, num)


def test_join_in_small_blocks_and_random_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng, rows = random.Random(2), []
    for base in range(4):
        words = [f"w{base}.{i}" for i in range(60)]
        for k in range(25):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(60)] = f"v{rng.randrange(40)}"
            rows.append((100 * base + k, " ".join(copy)))
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=80, den=100)
    assert {tuple(r) for r in found.collect()} == joined(rows, 3, 80)


def test_join_keeps_one_of_each_group(docs, empty):
    expected = {k for k, _, c in joined(documents(), 5, 80) if k == c}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == expected
    assert ngram_join.keep_one(empty).count() == 0
    assert ngram_join.near_duplicates(empty).count() == 0


def test_similar_sets_share_a_tile():
    rng = np.random.default_rng(1)
    for num in (40, 50, 60, 80, 90):
        for _ in range(300):
            size = int(rng.integers(1, 400))
            a = np.unique(rng.integers(1, 1 << 63, size, dtype=np.uint64))
            most = len(a) * (100 - num) // num
            drop = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate((a[drop:], rng.integers(1, 1 << 63, most - drop, dtype=np.uint64))))
            if ngram_join.enough(a, b, num, 100):
                assert set(ngram_join.tile_keys(a, num, 100).tolist()) & set(ngram_join.tile_keys(b, num, 100).tolist())
                for times in (1, 4):
                    bits = [np.frombuffer(ngram_join.bitmap(x, times), np.uint64) for x in (a, b)]
                    bits = [ngram_join.folded(x, min(map(len, bits))) for x in bits]
                    assert ngram_join.may_link(len(a), len(b), int(np.bitwise_count(bits[0] ^ bits[1]).sum()), num, 100)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    nodes = {x for p in links for x in p}
    found = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == set(components(nodes, links).items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 2: media


def test_media_round_trip(docs, empty):
    found = {r.doc_id: r for r in media.media_features(docs).collect()}
    for row in documents():
        data = (row[1] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = found[row[0]]
        wave = media.wave_header(len(payload)) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(wave), hashlib.sha256(wave).hexdigest(), media.feature(payload))
    lists, store = media.manifests(docs), media.chunk_store(docs)
    rebuilt = {r.manifest: r.media for r in media.rebuild(lists, store).collect()}
    texts = {r[0]: (r[1] or "").encode() for r in documents()}
    for r in lists.collect():
        assert media.samples_of(bytes(rebuilt[r.manifest]))[: r.n_bytes] == texts[r.doc_id]
    assert store.count() == store.select("digest").distinct().count()
    assert media.media_features(empty).count() == 0


def test_missing_chunk_is_an_error(docs):
    store = media.chunk_store(docs).limit(3)
    with pytest.raises(Exception, match="missing"):
        media.rebuild(media.manifests(docs), store).collect()


def test_chunks_follow_content():
    rng = random.Random(4)
    body = bytes(rng.randrange(256) for _ in range(200_000))
    chunks = [set(media._chunks(x)) for x in (body, b"shift" + body)]
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0])
    for data in (body, bytes(100_000), b"x" * 64):
        parts = list(media._chunks(data))
        assert b"".join(parts) == data
        assert all(media.LEAST <= len(p) <= media.LARGEST for p in parts[:-1])


# ---------------------------------------------------------------- 3: sharding


def test_shards(docs, empty):
    rows = documents()
    found = sharding.assign(docs, shards=5).collect()
    assert sharding.assign(empty).count() == 0
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    for s in {r.shard for r in found}:
        assert 0 <= s < 5
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    where = collections.defaultdict(set)
    for r in found:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def least_capacity(sizes, shards):
    """By dynamic programming."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    best = ends.astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))])
    return int(best[-1])


@pytest.mark.parametrize("giant", [0, 4000])
def test_capacity_is_the_smallest(spark, monkeypatch, giant):
    monkeypatch.setattr(sharding, "MAX_CELLS", 64)
    rng = random.Random(giant)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), rng.randint(1, 60)) for i in range(150)]
    if giant:
        rows[7] = (rows[7][0], giant)
    cuts = sharding.find_cuts(spark.createDataFrame(rows, "digest string, bytes long"), 8)
    loads = collections.Counter()
    for d, n in rows:
        loads[sum(d[: len(c)] > c for c in cuts)] += n
    assert max(loads.values()) == least_capacity([n for _, n in sorted(rows)], 8)


def test_few_groups(spark):
    found = sharding.assign(spark.createDataFrame([(i, "same" if i else None) for i in range(9)], "doc_id long, text string"), shards=8).collect()
    assert sorted(r.slot for r in found if r.size == 5) == list(range(8))


# ---------------------------------------------------------------- 4: decontamination


def hit(rows, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    of = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            of[tuple(w[k : k + window])].add(i)
    out = {}
    for r in rows:
        w, marks, ids = words(r[1]), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in of}:
                if k + n <= len(w) and (x := of.get(tuple(w[k : k + n]))):
                    marks |= set(range(k, k + n))
                    ids |= {str(i) for i in x if i is not None}
        out[r[0]] = (len(w), len(marks), len(ids), decontaminate.items_digest(list(ids)), len(marks) > 0 and 20 * len(marks) >= len(w))
    return out


def bench(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    items = [(i, " ".join(texts[i].split()[3 : 5 + 4 * i])) for i in range(9)]
    return [*items, (20, None), (21, ""), (22, "two words"), (23, items[7][1]), (24, items[8][1].upper() + "!"), (24, items[8][1]), (25, "never seen here at all by any one of those documents in the whole table"), (None, items[6][1])]


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_hits(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows, items = documents(), bench(documents())
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.report(docs, table).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert {r[0]: tuple(r)[1:] for r in found} == hit(rows, items)
    assert decontaminate.report(empty, table).count() == 0
    kept = decontaminate.decontaminate(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, x in hit(rows, items).items() if not x[4]}
    none = decontaminate.decontaminate(docs, table.limit(0))
    assert none.count() == len(rows)


@pytest.mark.parametrize(("part", "block"), [(64, 1 << 19), (64, 300), (1 << 16, 1 << 19)])
def test_parts_of_a_long_item(spark, docs, monkeypatch, part, block):
    """A long item is cut into parts, each window whole, and counts as one item."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "PART_BYTES", part)
    rows = documents()
    items = [(i, x) for i, x in bench(rows) if i in (8, 22)] + [(30, " ".join(r[1] for r in rows[:9] if r[1])), (31, "x" * 300)]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert (decontaminate.item_parts(table.select(F.col("item_id").alias("id"), "text"), 13).count() > len(items)) == (part == 64)
    found = decontaminate.report(docs, table).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert {r[0]: tuple(r)[1:] for r in found} == hit(rows, items)


def test_cut_spans(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before it. {item}, and after!"), (2, "clean text")], "doc_id long, text string")
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), action="cut")
    assert {r.doc_id: r.text for r in found.collect()} == {1: "Before it. , and after!", 2: "clean text"}


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_blocks_judge_together(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    runs = [" ".join(f"w{i}x{j}" for j in range(13)) for i in range(12)]
    items = spark.createDataFrame(list(enumerate(runs)), "item_id long, text string")
    filler = lambda n: " ".join(f"f{i}" for i in range(n))
    # twelve items in several blocks: each alone hits 13 of 3120 words, all of them a twentieth
    rows = [(1, " | ".join(runs) + " " + filler(20 * 156 - 156)), (2, " | ".join(runs) + " " + filler(20 * 156 - 155)), (3, "clean"), (None, None), (1, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert (len(decontaminate.item_blocks(items, "item_id", "text", 13)) > 1) == (block == 300)
    plain = lambda df: collections.Counter(map(tuple, df.collect()))
    assert plain(decontaminate.decontaminate(docs, items)) == collections.Counter(rows[1:])
    cut = decontaminate.decontaminate(docs, items, action="cut")
    assert cut.columns == docs.columns
    assert plain(cut) == collections.Counter([(1, " " + filler(20 * 156 - 156)), *rows[1:]])
    # a range that the items of several blocks cover jointly counts as one
    assert plain(decontaminate.decontaminate(docs, items, coverage=1, longest=156)) == collections.Counter(rows[2:])


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_hits_of_each_row(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = spark.createDataFrame([(i, f"one{i} two{i} three{i}") for i in range(9)], "item_id long, text string")
    rows = [(1, "one0 two0 three0 x"), (1, "one0 two0 three0 x"), (1, "y one1 two1 three1"), (None, "a b c d"), (None, "z one2 two2 three2"), (None, None), (2, ""), (2, "")]
    found = decontaminate.hits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), items)
    assert found.columns == ["doc_id", "n_words", "spans", "items"]
    one = [(1, 4, ((0, 3),), ("0",))] * 2 + [(1, 4, ((1, 4),), ("1",)), (None, 4, (), ()), (None, 4, ((1, 4),), ("2",)), (None, 0, (), ()), (2, 0, (), ()), (2, 0, (), ())]
    assert collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in found.collect()) == collections.Counter(one)


def test_automaton_on_repetitions():
    rng = random.Random(0)
    for _ in range(60):
        items = [(i, [rng.choice("ab") for _ in range(rng.randint(1, 9))]) for i in range(4)]
        words = [rng.choice("abc") for _ in range(60)]
        spans, ids = decontaminate.Automaton(items, 4).spans(words)
        row = hit([(0, " ".join(words))], [(i, " ".join(w)) for i, w in items], 4)[0]
        assert (sum(e - s for s, e in spans), len(ids)) == row[1:3]


# ---------------------------------------------------------------- 5: url filter


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/EN/x?y#z", "http://www.example.com/en/", "http://a.example.com/en/1", "http://aexample.com/en/1", "http://x.net/es/q", "x://net/fr/?a", "http://casino-win.example.org/en/5", "http://library.org?q=://b", "http://h#frag/es/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    weights = url_filter.fit(url_filter.labelled_urls(spark))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, weights).collect()}
    assert found[0] == ("", "", None, "allow") and found[1][:3] == ("", "", None) and found[2][:3] == ("", "", None)
    assert found[4] == ("www.example.com", "/EN/x", "com/", "allow")
    assert found[5] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert found[6] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert found[7] == ("aexample.com", "/en/1", "com/", "allow")
    assert found[8][2:] == ("net/es/", "block") and found[9] == ("net", "/fr/", "net/fr/", "block")
    assert found[10][2:] == (None, "block") and found[11] == ("library.org", "", None, "allow") and found[12][:3] == ("h", "", None)
    assert url_filter.judge(pages.limit(0), weights).count() == 0
    assert url_filter.fit(pages.select("url", F.lit(1).alias("label")).limit(0)) == [0.0] * (url_filter.BUCKETS + 1)


def brute_probability(rows, host, path):
    """The model's probability, in plain Python: the weights that full-batch descent reaches on the hashed grams, which Spark hashes."""
    w = [0.0] * (url_filter.BUCKETS + 1)
    for _ in range(url_filter.PASSES):
        errors = [y - 1 / (1 + math.exp(-sum(w[b] for b in grams) / 8)) for grams, y in rows]
        step = [0.0] * len(w)
        for (grams, _), e in zip(rows, errors, strict=True):
            for b in grams:
                step[b] += e
        w = [x + url_filter.STEP * (g / len(rows) - url_filter.RIDGE * x) for x, g in zip(w, step, strict=True)]
    return w


def test_url_model_is_logistic_regression(spark):
    table = url_filter.labelled_urls(spark)
    rows = table.select("label", url_filter.grams_of(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("g")).collect()
    assert url_filter.fit(table) == pytest.approx(brute_probability([([*r.g, url_filter.BUCKETS], r.label) for r in rows], "", ""), abs=1e-6)


def test_url_model_on_held_out_hosts(spark):
    """No host of a fold is in its training table."""
    table = url_filter.labelled_urls(spark).withColumn("fold", F.pmod(F.xxhash64(url_filter.host_of(F.col("url"))), F.lit(4)))
    right = total = 0
    for k in range(4):
        found = url_filter.judge(table.where(F.col("fold") == k).withColumn("page_id", F.col("label")), url_filter.fit(table.where(F.col("fold") != k)))
        for r in found.collect():
            right, total = right + ((r.score >= 0.5) == (r.page_id == 1)), total + 1
    print("held-out hosts", right, total)
    assert right >= 0.8 * total


def test_labelled_table_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LABELLED", 10)
    with pytest.raises(ValueError, match="more than"):
        url_filter.fit(url_filter.labelled_urls(spark))


# ---------------------------------------------------------------- 6: html


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>No.";</script></head><body>
<header>No, no header.</header><nav><ul><li><a href="/x">No</a></li><li>Menu, no.</ul></nav><!-- no <p>no</p> -->
<div class="ad">Buy this now, it is cheap.</div>{}<aside>No. Side, bar.</aside><form>Name, please: <input></form>
<div id="comments"><p>First comment, no. Very long comment, with points. And more, so that it weighs.</p></div><footer>&copy; No, nothing.</footer></body></html>"""


def page(inner):
    return PAGE.replace("</div>{}<aside>", f"</div>{inner}<aside>")


def test_html(spark):
    inner = "<h1>The  head</h1><p>One &amp; two,<br>three. &lt;b&gt;<p><b>Next &eacute;</b> <i>one</i>&nbsp;,\n here.</p><ul><li>Point one, so.<li>Point two.</ul><div class='share'>Share, no.</div><p>Last."
    text = "The head\nOne & two, three. <b>\nNext é one , here.\nPoint one, so.\nPoint two.\nLast."
    pages = [page(f"<article>{inner}</article>"), page(f"<div class=content>{inner}</div>"), page(f"<main><header><h1>Above</h1></header>{inner}</main>"), None, "", "plain words, no tags.", "<nav>a</nav>", "<article><p>cut off, <b>here</b> and the", "<p>a<p", "<", "<p title=\"x>y\">q.</p>"]
    expected = [text, text, "Above\n" + text, "", "", "plain words, no tags.", "", "cut off, here and the", "a", "<", "q."]
    rows = spark.createDataFrame([(i, None if i == 2 else "u", p, "t", 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    found = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(rows).collect()}
    assert found == {i: (t, len(t)) for i, t in enumerate(expected)}
    assert html_extract.main_text(rows.limit(0)).count() == 0


def test_long_html():
    long = page("<article>" + "<p>Some words, and more.</p>" * 20_000 + "</article>")
    assert html_extract.extract_text(long).count("\n") == 19_999
    assert html_extract.extract_text("<div>" * 100_000 + "Deep, yes.") == "Deep, yes."
    assert html_extract.extract_text("<div>x, y." * 30_000 + "</b></section>" * 30_000).count("\n") > 0


TALK = "<p>This is a long paragraph, with commas, and a point. It has more, and more words, to be long enough.</p>"


def test_names_do_not_empty_a_page():
    text = TALK[3:-4]
    for body in ('<body class="has-sidebar">', '<body class="page no-sidebar">', '<body class="modal-open">', '<body class="sidebar">'):
        assert html_extract.extract_text(f"<html>{body}<h1>T</h1>{TALK * 3}</body></html>").split("\n") == ["T", *[text] * 3]
    assert html_extract.extract_text(f'<article class="notice">{TALK * 2}</article>').count(text) == 2
    assert html_extract.extract_text(f"<body><div class='widget'><article>{TALK * 2}</article></div>").count(text) == 2
    assert "It rose, and fell." in html_extract.extract_text(f"<article>{TALK}<div class='share-price'>It rose, and fell.</div>{TALK}</article>")
    gone = html_extract.extract_text(f"<article>{TALK}<div class='shareButtons'>Send, mail.</div><div id='post-comments'>{TALK}</div><div class='cookie-banner'>Yes, no.</div></article><div class=sidebar>{TALK}</div>")
    assert gone == text


def test_short_parts_of_an_article_stay():
    page = f"<nav><a href=/>Home</a></nav><article><h1>T</h1>{TALK * 4}<table><tr><td>a1</td><td>b 2</td></tr></table><blockquote><p>Short.</p></blockquote><figure><img><figcaption>Seen</figcaption></figure><ul><li><a href=x>ref</a></li></ul>{TALK}<ul><li><a href=y>more</a></li></ul></article>"
    lines = html_extract.extract_text(page).split("\n")
    assert [x for x in lines if x != TALK[3:-4]] == ["T", "a1", "b 2", "Short.", "Seen", "ref"]


def test_odd_pages_do_not_fail():
    linked = "<html><body><div><p>Hello there.</p><p><a href='/x'>" + "long link text " * 20 + "</a></p></div></body></html>"
    assert html_extract.extract_text(linked) == ""
    assert [html_extract.extract_text(x) for x in ("<a>x</a>", "<p>x</p>", "no tags", "<li><a>a</a><li><a>b</a>", "", None)] == ["", "x", "no tags", "", "", ""]
    rng = random.Random(0)
    tags = "html body div p article main section h1 h2 ul li a table tr td blockquote figcaption header footer nav aside span b br script style".split()
    for _ in range(3000):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            t, r = rng.choice(tags), rng.random()
            parts.append(f"<{t}{rng.choice(['', ' class=sidebar', ' class=no-ad', ' id=x'])}>" if r < 0.45 else f"</{t}>" if r < 0.65 else rng.choice(["Text, here. ", "x", "", "&amp;", "<!--", "<", "a link. "]))
        html_extract.extract_text("".join(parts))


def test_path_ratios_decide(monkeypatch):
    """No article, and boilerplate without telling names: what the paths' text and punctuation say decides."""
    links = "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(30))
    tags = "".join(f"<span><b>tag {i}</b></span><i></i><section>tag {i}</section>" for i in range(30))
    text = "".join(f"<p>Sentence one of {i}, with a comma. Sentence two, longer than the first; it ends here.</p>" for i in range(12))
    page = f"<body><div class=x1><ul>{links}</ul></div><div class=x2><h2>Head</h2>{text}<p>Short.</p><ul>{links}</ul></div><div class=x3>{tags}</div></body>"
    lines = html_extract.extract_text(page).split("\n")
    assert lines[0] == "Head" and lines[-1] == "Short." and len(lines) == 14
    monkeypatch.setattr(html_extract, "THRESHOLD", 0.0)
    assert html_extract.extract_text(page).split("\n") != lines


# ---------------------------------------------------------------- 7: token counts


def test_counts_follow_edits(spark, docs, empty):
    rng = random.Random(8)
    with open(token_count.RANKS, "rb") as f:
        coder = token_count.encoding(f.read())
    for row in documents():
        text = row[1] or ""
        tree = token_count.CountTree(text, coder)
        for _ in range(12):
            place, delete = rng.randint(-2, len(text) + 3), rng.choice([0, 1, 5, 600, 5000])
            insert = rng.choice(["", " ", "x", " word", "  two\n", "'s", " and more" * 150])
            tree.edit(place, delete, insert)
            at = min(max(place, 0), len(text))
            text = text[:at] + insert + text[at + delete :]
            assert tree.text == text
            assert (tree.tokens[1], tree.chars[1]) == (len(coder.encode_ordinary(text)), len(text))
    edits = spark.createDataFrame([(1, 2, 0, 3, "ab"), (1, 1, 5, None, None), (4, 1, None, 0, "start ")], "doc_id long, seq int, place int, delete int, insert string")
    found = {r.doc_id: r for r in token_count.count_edited(token_count.with_edits(docs, edits)).collect()}
    for row in documents():
        text = row[1] or ""
        after = {1: "ab" + text[3:], 4: "start " + text}.get(row[0], text)
        assert (found[row[0]].n_tokens_before, found[row[0]].n_tokens) == (len(coder.encode_ordinary(text)), len(coder.encode_ordinary(after)))
    assert token_count.count_edited(token_count.with_edits(empty, edits)).count() == 0


def test_tree_grows():
    with open(token_count.RANKS, "rb") as f:
        coder = token_count.encoding(f.read())
    tree = token_count.CountTree("", coder)
    tree.edit(0, 0, " and more" * 12_000)
    assert len(tree.leaves) > 100
    before = tree.recoded
    tree.edit(54_321, 1, "x")
    assert tree.recoded - before < 4 * token_count.LEAF
    tree.edit(100, 100_000, "")
    assert (tree.tokens[1], tree.text) == (len(coder.encode_ordinary(tree.text)), (" and more" * 12_000)[:54_321] [:100] + ((" and more" * 12_000)[:54_321] + "x" + (" and more" * 12_000)[54_322:])[100_100:])


def test_edits_are_local():
    with open(token_count.RANKS, "rb") as f:
        coder = token_count.encoding(f.read())
    tree = token_count.CountTree(" ".join(f"word{chr(97 + i % 26)}" for i in range(50_000)), coder)
    tree.edit(100_000, 5, "changed")
    assert tree.recoded < 4 * token_count.LEAF


# ---------------------------------------------------------------- 8: repeated bytes


def removed(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if (w := data[i : i + length]) in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(w)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(mark))]
        out[key] = (spans, bytes(x for x, y in zip(data, mark, strict=True) if not y))
    return out


@pytest.mark.parametrize(("hot", "block"), [(20_000, 1 << 19), (1, 1 << 19), (1, 3000)])
def test_repeats(spark, docs, empty, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(1)
    rows = [(r[0], r[1]) for r in documents()] + [(900, "a" * 700), (901, "ab" * 400), (902, "ab" * 60 + "é" * 80), (903, "".join(rng.choice("ab ") for _ in range(3000)))]
    rows.append((904, rows[-1][1][500:900] + "zz" + rows[-1][1][1000:1300]))
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in found} == removed(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_row_with_a_shared_passage(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(400)
    rows = [(i, say(150) + passage + say(150)) for i in range(1, 6)]
    rows += [rows[0], rows[0], rows[2]]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = removed(rows)
    assert want[1][0] == [] and len(want[2][0]) == 1
    plain = lambda key, spans, kept: (key, tuple(map(tuple, spans)), bytes(kept))
    assert collections.Counter(plain(*r) for r in found) == collections.Counter(plain(k, *want[k]) for k, _ in rows)


def test_windows_of_one_key_in_several_blocks(monkeypatch):
    """Many places of few windows, in blocks much smaller than a key's rows: all but each one's first are found, and little is held."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rng = random.Random(5)
    texts = {k: [bytes(rng.choices(b"abc", k=100)) for _ in range(2)] for k in (7, 8)}  # equal texts have one key
    places = rng.sample([(d, 1000 * s) for d in range(9) for s in range(100)], 400)
    rows = sorted(((rng.choice([7, 8]), d, s) for d, s in places), key=lambda r: r[0])  # a key's places come in any order
    rows = [(k, d, s, rng.choice(texts[k])) for k, d, s in rows]
    first = {}
    for _, d, s, x in rows:
        first[x] = min(first.get(x, (d, s)), (d, s))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 50], strict=True)], ["anchor", "doc", "start", "slice"]) for i in range(0, len(rows), 50)]
    out = pa.Table.from_batches(list(suffix_dedup._blocks(100, windows=True)(iter(batches)))).to_pylist()
    assert sorted((r["doc"], r["start"], r["stop"]) for r in out) == sorted((d, s, s + 100) for _, d, s, x in rows if (d, s) != first[x])


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 500)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, base), (2, "xy" + base[700:4000]), (3, base[:1200] + base)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in found.collect()} == removed(rows)


def test_repeats_over_many_batches(spark):
    """A task sends on a shared passage once, and again where it finds an earlier place of it."""
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(260)
    rows = [(rng.randrange(1000) * 100 + i, say(rng.randrange(80)) + passage[rng.randrange(40) :] + say(30)) for i in range(60)]
    rows += [rows[3], (None, passage)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last = [(10**9 if k is None else k, t) for k, t in rows]
    assert {10**9 if r.doc_id is None else r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in found} == removed(last) and len(found) == len(rows)
    seen, one = suffix_dedup.Seen(), lambda *x: np.array(x, np.int64)
    assert [x.tolist() for x in seen.sort_out(one(5, 6), one(9, 9), one(0, 0))] == [[True, True], [False, False]]
    assert [x.tolist() for x in seen.sort_out(one(5, 5, 6, 7), one(9, 10, 3, 1), one(0, 0, 8, 0))] == [[False, False, True, True], [False, True, False, False]]


def test_suffix_order():
    rng = np.random.default_rng(2)
    for n in [0, 1, 2, 3, *rng.integers(4, 300, 60).tolist()]:
        data = rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8)
        text, found = data.tobytes(), suffix_dedup.suffix_order(data, 300).tolist()
        assert found == sorted(range(n), key=lambda i: text[i:])


# ---------------------------------------------------------------- 9: language id


def test_languages(spark, docs, empty):
    rng = random.Random(6)
    words = {"en": "the of and that with have from this which their would about".split(), "de": "der die und nicht werden auch eine einem durch über wurde zwischen".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 90))), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "12 - 34!", "en"), (503, "the of and that with have", None), (504, "THE OF AND! " * 5000, "en"), (0, rows[0][1], "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = langid.train(table.where(~langid.held_out()))
    assert set(dictionaries) == {"en", "de"}
    found = {r.doc_id: r for r in langid.predict(table, dictionaries).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows[:120])
    assert [found[i].lang_pred for i in (500, 501, 502, 503, 504)] == ["und", "und", "und", "en", "en"]
    kept = langid.keep_known(table, dictionaries)
    assert kept.columns == table.columns and kept.count() == len(rows) - 3
    assert langid.predict(empty, dictionaries).count() == 0
    assert langid.train(empty) == {}
    assert {r.lang_pred for r in langid.predict(table, {}).collect()} == {"und"}


def smallest(texts, dictionaries, least=None):
    """Name of the smallest size and how far the next lies behind, by plain zstandard; with `least` also as a share of that many bytes at most."""
    out = []
    for text in texts:
        data = re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode()
        sizes = []
        for name, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append((len(c.compress(data)), name))
        sizes.sort()
        margin = sizes[1][0] - sizes[0][0]
        out.append((sizes[0][1], margin / sizes[1][0]) if least is None else (sizes[0][1], margin / sizes[1][0], margin / min(sizes[1][0], least)))
    return out


def test_predictions_are_the_smallest_sizes(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = langid.train(table.where(~langid.held_out()))
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect() if r.text and re.search("[A-Za-z]", r.text)]
    found = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in langid.predict(table, dictionaries, margin=0.05).collect()}
    for (key, _, _), (name, score) in zip(rows, smallest([t for _, t, _ in rows], dictionaries), strict=True):
        assert found[key][:2] == (name, pytest.approx(score))
    held = [(key, lang) for key, _, lang in rows if zlib.crc32(str(key).encode()) % 4 == 2 and lang]
    assert sum(found[key][0] == lang for key, lang in held) >= 0.95 * len(held)


def test_no_language_is_lost(spark):
    """Copies of one text, and very many of them, still make a dictionary."""
    rows = [("en", f"some words of text {i}") for i in range(2000)] + [("de", "ein einziger Satz, oft")] * 3000 + [("fr", "un seul texte")]
    table = spark.createDataFrame(rows, "lang string, text string")
    for seed in range(6):
        found = langid.train(table, seed=seed)
        assert set(found) == {"en", "de", "fr"} and found["de"] == "ein einziger satz oft".encode()
        assert 70 < found["en"].count(b"text") < 180


# ---------------------------------------------------------------- 10: mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == [200, 100 * 250 / 300, 500 / 3]
    assert mixing.targets([10, 0], [1, 5], 1.5, 2.0) == [15, 0]
    assert mixing.targets([], [], 1.5, 2.0) == [] and mixing.targets([0], [3], 1.5, 2.0) == [0]


def test_tree_keeps_quotas():
    quotas = np.array([5, 0, 1000, 37, 2])
    dealt = mixing.splitting_tree(quotas, 8, np.random.default_rng(1))
    assert (dealt >= 0).all() and (dealt.sum(axis=1) == quotas).all()
    assert dealt.sum(axis=0).max() - dealt.sum(axis=0).min() <= 3
    assert (dealt == mixing.splitting_tree(quotas, 8, np.random.default_rng(1))).all()


def test_mix(spark, docs, empty):
    rows = documents()
    found = mixing.takes(docs).collect()
    assert len(found) == len(rows) and mixing.takes(empty).count() == 0
    texts, sources = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    sizes, taken, goal = collections.Counter(), collections.Counter(), {}
    for r in found:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and r.taken in (0, r.size, 2 * r.size)
        sizes[sources[r.doc_id]] += r.size
        taken[sources[r.doc_id]] += r.taken
        goal[sources[r.doc_id]] = r.target
    order = sorted((s for s in sizes if s is not None)) + [None]
    expected = mixing.targets([sizes[s] for s in order], [3, 1, 2, 3], 1.5, 2.0)
    assert [goal[s] for s in order] == pytest.approx(expected)
    for r in found:
        assert r.source_size == sizes[sources[r.doc_id]] and r.taken == r.size * len(r.shards) and set(r.shards) <= set(range(8))
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(r.size for r in found if sources[r.doc_id] == s)
    blocks = {r: mixing.plan(mixing.sized(docs, "doc_id", "source", "text", 7)).groupBy("origin").agg(F.flatten(F.collect_list("shards")).alias("s")).collect() for r in (0,)}[0]
    draws = {r.origin: np.bincount(r.s, minlength=8) for r in blocks}
    names = sorted(draws, key=lambda o: (o == "null", o))
    tree = mixing.splitting_tree(np.array([draws[o].sum() for o in names]), 8, np.random.default_rng(7))
    assert all((draws[o] == row).all() for o, row in zip(names, tree, strict=True))
    again = mixing.takes(docs.repartition(7)).collect()
    assert sorted(again) == sorted(found)
    mixed = mixing.mix(docs, with_shard=True)
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_copy"]
    per = collections.Counter(r.doc_id for r in found)
    for r in found:
        if r.size:
            assert counts[r.doc_id] == per[r.doc_id] * r.taken // r.size
    assert {r.mix_shard for r in mixed.collect()} <= set(range(8))
    assert mixing.mix(empty).count() == 0
