"""Resampling, vector codes and piece encoding against plain versions, with nulls, empty and long values, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from chronofeat.llm import piece_encode, resample, vector_codes

UP = str.maketrans({c: c + 32 for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Extra columns bear the names that the operators use inside.
EXTRA = "key string, codes string, score string, id long, label string, vector string, ids string, rank long"
NOTHING = ("k", "c", "s", 1, "l", "v", "i", 2)

# ---------------------------------------------------------------- 11: resampling


def texts(seed=3, n=90):
    rng = random.Random(seed)
    words = ["the", "of", "Über", "ñandú", "a", "in", "zero", "X1", "e", "st", "and", "on", "日本", "tre-", "ed,", "İ"]
    say = lambda k: rng.choice([" ", "\n", " - "]).join(rng.choice(words) for _ in range(k))
    out = [say(rng.randint(1, 60)) for _ in range(n)]
    return [*out, out[0], out[0], None, "", " .,;", "Word", "İ", say(30_000)]


def runs(text, longest):
    words = WORD.findall((text or "").translate(UP))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def drawn(rows, items, longest, buckets, percent, least, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = ([0] * buckets for _ in range(2))
    for side, sums in ((rows, s), ([(None, x) for x in items], t)):
        for _, text in side:
            for g in runs(text, longest)[1]:
                sums[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for key, text in rows:
        words, features = runs(text, longest)
        weight = sum(gain[bucket(g)] for g in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(features), weight, score, None, len(words)])
    long_enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(long_enough[: percent * len(long_enough) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(2, 10_000, 25, 20), (1, 7, 100, 0), (3, 500, 50, 5)])
def test_draw(spark, longest, buckets, percent, least):
    rows = [(7 * i, t) for i, t in enumerate(texts())]
    rows += [rows[2], (None, "the of a in zero " * 9)]
    items = [*texts(seed=4, n=10)[:10], None, ""]
    docs = spark.createDataFrame([(*r, *NOTHING) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(3)
    target = spark.createDataFrame([(x,) for x in items], "text string")
    found = resample.draw(docs, target, longest=longest, buckets=buckets, percent=percent, min_words=least).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(drawn(rows, items, longest, buckets, percent, least, 7), key=repr)


def test_draw_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    one = spark.createDataFrame([("a", "x " * 30), ("b", None)], "doc_id string, text string")
    assert resample.draw(docs, docs).collect() == []
    assert {(r.doc_id, r.n_features, r["rank"]) for r in resample.draw(one, docs, percent=100).collect()} == {("a", 59, 1), ("b", 0, None)}


def test_resample_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, *NOTHING) for i, t in enumerate(texts())], f"doc_id long, text string, {EXTRA}")
    kept = resample.resample(docs, docs.limit(5))
    assert kept.columns == docs.columns
    assert kept.count() == resample.draw(docs, docs.limit(5)).where("rank IS NOT NULL").count() > 0


# ---------------------------------------------------------------- 12: vector codes


def compressed(rows, parts, entries, rounds):
    """Plain k-means in whole numbers; rows (id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max([len(v) for _, v, _ in kept] + [1]) // parts) * parts
    whole = [[max(-(1 << 27), min(1 << 27, math.floor(4096 * x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0], kept[i][1]))
    d = width // parts
    cut = lambda v, p: v[p * d : p * d + d]
    books = [[cut(whole[i], p) for i in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for v in whole:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else e for m, e in zip(members, books[p], strict=True)]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for v in whole]
    errors = [sum(x for x, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)]


def vectors(seed=1, n=300, width=16):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    rows = [(3 * i + 100, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice(["a", "b", None])) for i in range(n)]
    same = [float(k % 3) for k in range(width)]
    return rows + [(5, same, "a"), (5, same, "a"), (1, same[::-1], None), *[(9000 + k, same, "b") for k in range(150)]]


ODD = [(2, None, "a"), (3, [float("nan")] * 16, "a"), (4, [1.0, None] * 8, "a"), (6, [float("inf")] * 16, "b"), (None, [0.25] * 16, "c"), (8, [1e30] * 16, "c"), (11, [-1e30, 1e30] * 8, "c"), (10, [], "a"), (12, [0.5] * 5, None)]


@pytest.mark.parametrize(("rows", "parts", "entries", "rounds"), [(vectors(), 8, 16, 6), (vectors() + ODD, 8, 16, 6), (vectors(width=7), 2, 5, 3), (vectors()[:7], 4, 16, 2), (ODD[:4], 8, 16, 6)])
def test_codes(spark, monkeypatch, rows, parts, entries, rounds):
    df = spark.createDataFrame([(*r, *NOTHING[:3], NOTHING[-1]) for r in rows], "vec_id long, embedding array<double>, label string, key string, codes string, score string, rank long").repartition(2)
    found = sorted(map(tuple, vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds).collect()), key=repr)
    assert found == sorted(compressed(rows, parts, entries, rounds), key=repr)


def test_chunks_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label string").repartition(3)
    before = sorted(map(tuple, vector_codes.compress(df).collect()))
    codes = vector_codes.chunks(vector_codes.kept_vectors(df, "vec_id", "embedding", "label"), 16, 8)
    books = vector_codes.first_codebooks(vector_codes.kept_vectors(df, "vec_id", "embedding", "label"), 16, 8, 16)
    assert sorted(r["error"] for r in vector_codes.encode(codes, vector_codes.train(codes, books, 6)).collect()) == sorted(r[2] for r in before)
    assert vector_codes.compress(df.limit(0)).collect() == []


def test_shortlists_hold_the_nearest():
    rng = np.random.default_rng(5)
    for d in (1, 2, 8):
        points = rng.integers(-50, 50, (9, d))[rng.integers(0, 9, 900)] + rng.integers(-4, 4, (900, d))
        points = points[vector_codes.hilbert_keys(points)]
        boxes, sums = vector_codes.Part.cut(points)
        part = vector_codes.Part(points, boxes, sums)
        entries = rng.integers(-50, 50, (16, d))
        distance = ((points[:, None] - entries) ** 2).sum(axis=2)
        assert (part.codes(entries)[0] == distance.argmin(axis=1)).all()
        assert part.shortlists(entries).mean() < 1
        spread = np.abs(np.diff(points, axis=0)).sum(axis=1).mean()
        assert spread < np.abs(np.diff(rng.permutation(points), axis=0)).sum(axis=1).mean()


# ---------------------------------------------------------------- 13: pieces


@pytest.fixture(scope="module")
def pieces():
    with open(piece_encode.MODEL, "rb") as f:
        return piece_encode.Pieces(f.read())


def odd_texts(library, n=400, seed=2):
    rng = random.Random(seed)
    known = [library.id_to_piece(i).replace(piece_encode.SPACE, " ") for i in range(259, library.get_piece_size())]
    chars = "abcde  \n.,123éß漢字=-_\x00　ﬁ😀𐍈"
    out = ["", " ", "a" * 3000, " " * 3000 + "x", "=" * 1500, "ab" * 900, "<s></s><unk><0x41>", "▁▁ a▁"]
    for _ in range(n):
        out.append("".join(rng.choice(known) for _ in range(rng.randrange(1, 30))))
        out.append("".join(rng.choice(chars) for _ in range(rng.randrange(1, 60))))
        out.append("".join(rng.choice(["a", "th", "e", " ", "=", "  "]) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 200))))
    return out


def test_ids_are_the_library_s(pieces, monkeypatch):
    found = odd_texts(pieces.library)
    expected = pieces.library.encode(found, add_bos=True, add_eos=True)
    assert [x.tolist() for x in pieces.encode(found)] == expected
    assert [x.tolist() for x in pieces.encode(found)] == expected  # words that it remembers
    monkeypatch.setattr(piece_encode, "LONG", 4)
    monkeypatch.setattr(piece_encode, "TOGETHER", 50)
    monkeypatch.setattr(piece_encode, "KNOWN", 1000)
    with open(piece_encode.MODEL, "rb") as f:
        again = piece_encode.Pieces(f.read())
    assert [x.tolist() for x in again.encode(found)] == expected


def test_rounds_of_long_words(pieces, monkeypatch):
    monkeypatch.setattr(piece_encode, "LONG", 1 << 30)
    found = ["a" * 700, " " * 300 + "x", "=" * 500, "abab" * 100]
    assert [x.tolist() for x in pieces.encode(found)] == pieces.library.encode(found, add_bos=True, add_eos=True)


def test_digests(spark):
    library = SentencePieceProcessor(model_file=piece_encode.MODEL)
    rows = [(i, t) for i, t in enumerate([*odd_texts(library, 40), None, "Über den Bergen. " * 20_000])]
    rows += [rows[3], (None, "x")]
    df = spark.createDataFrame([(*r, *NOTHING) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(2)
    expected = []
    for key, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        expected.append((key, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    assert sorted(map(tuple, piece_encode.digests(df).collect()), key=repr) == sorted(expected, key=repr)
    assert piece_encode.digests(df.limit(0)).collect() == []
    whole = piece_encode.encoded(df.where("doc_id = 8")).first()
    assert whole.ids == library.encode(rows[8][1], add_bos=True, add_eos=True) and whole.decoded == library.decode(list(whole.ids))
