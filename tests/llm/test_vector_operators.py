"""Neighbours, resampling and whitening against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import connect
from pyspark.sql import functions as F

from textloom.llm import ann, catalog, resampling, whitening
from textloom.llm import arrays as ar
from textloom.llm import vectors as vx

VECTORS = "vec_id long, embedding array<float>, label int, vector string, id string, x string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "v", "i", "x") for r in rows], VECTORS)


def odd_rows():
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=6).round(2).tolist()) for i in range(120)]
    rows += [(i, [1.0, 0.5, 0.0, -0.5, 2.0, 1.0]) for i in range(200, 290)]  # one hot vector
    rows += [(7, rows[7][1]), (300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(304, [NAN] * 6), (305, [INF] + [0.0] * 5), (306, [1.0, 2.0]), (None, [1.0] * 6), (307, [-0.0] * 6)]
    return rows


# --- nearest neighbours ---------------------------------------------------------


def brute_neighbours(rows, every, k):
    kept = {
        (i, tuple(np.float32(e).astype(float)))
        for i, e in rows
        if i is not None and e and None not in e and len(e) == 6 and np.isfinite(e).all() and any(e)
    }
    out = set()
    for q, qe in kept:
        if q % every == 0:
            near = []
            for i, e in kept:
                if i != q:
                    total = 0.0
                    for a, b in zip(e, qe, strict=True):
                        total += a * b
                    near.append((-total, i))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(near)[:k])}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("codes", [ann.Codes(), ann.Codes(block=1500), ann.Codes(least_rows=10)])
def test_neighbours_of_odd_rows(spark, codes):
    got = ann.search(table(spark, odd_rows()), F.col("vec_id") % 20 == 0, codes=codes)
    assert found(got) == brute_neighbours(odd_rows(), 20, 20)


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0])]
    got = found(ann.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == {(0, 1, 20, 1.0), (0, 2, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 3, 0.0)}
    assert found(ann.search(table(spark, []), F.col("vec_id") % 20 == 0)) == set()
    assert found(ann.search(table(spark, [(3, [0.0, 1.0])]), F.col("vec_id") % 20 == 0)) == set()


def test_error_bound_and_recall():
    """Estimates lie within their bounds about as often as the bound says, and the
    marks lose no more than a tenth of the neighbours."""
    draw = np.random.default_rng(3)
    data = draw.normal(size=(3000, 48)) * draw.uniform(0.5, 2, size=(3000, 1)) + 0.3
    queries, c = data[:60], ann.Codes(epsilon=2.0)
    centre = data.mean(0)
    codes, length, along = ann.encode(data, centre, c.seed)
    assert codes.shape == (3000, 6)
    about, spread = ann.estimate(codes, length, along, queries, centre, c)
    true = queries @ data.T / np.linalg.norm(queries, axis=1)[:, None]
    inside = np.abs(about - true) <= spread
    assert 0.93 < inside[:, 60:].mean() < 0.99
    q, v, s = ann.nearest(data, codes, length, along, np.arange(3000), queries, centre, 20, c)
    want = {(i, j) for i in range(60) for j in np.argsort(-true[i], kind="stable")[:20]}
    assert len(want & set(zip(q.tolist(), v.tolist(), strict=True))) >= 0.97 * len(want)
    assert np.allclose(s, np.einsum("ij,ij->i", queries[q], data[v]))


def test_bound_keeps_every_neighbour():
    """Vectors without structure, whose estimates are wide off: none of the nearest
    may be lost by the bound, and scores are sums in order of components."""
    data = np.random.default_rng(3).normal(size=(3000, 64))
    queries, centre, c = data[:300], data.mean(0), ann.Codes()
    q, v, s = ann.nearest(data, *ann.encode(data, centre, c.seed), np.arange(3000), queries, centre, 20, c)
    near = np.argsort(-(queries @ data.T), axis=1, kind="stable")[:, :20]
    assert set(zip(q.tolist(), v.tolist(), strict=True)) == {(i, j) for i in range(300) for j in near[i].tolist()}
    assert (s == ann.products(data, queries, v, q)).all()


# --- importance resampling --------------------------------------------------------


def brute_sample(docs, target, percent=5, least=20, seed=42):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def runs(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(lower))
        spans = [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(x) % 10000 for x in spans]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(text)[1])
    for text in target:
        t.update(runs(text)[1])
    s_all, t_all = s.total() + 10000, t.total() + 10000
    rows = []
    for i, text in docs:
        n, found = runs(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, n >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], -r[1]))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = place + 1
    return Counter(tuple(r[:5]) for r in rows)


def sampled(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_resampling_equals_brute_force(spark, sf_dir):
    con = connect(sf_dir)
    docs = con.sql("SELECT doc_id, text FROM documents").fetchall()
    target = [r[0] for r in con.sql("SELECT text FROM benchmark").fetchall()]
    assert sampled(catalog.QUERIES["op12_importance_resampling"](spark, sf_dir)) == brute_sample(docs, target)


def test_resampling_of_odd_rows(spark):
    draw = random.Random(2)
    some = ["Über", "the", "a1", "x" * 70, "y" * 300, "STRASSE", "straße", "9", "語"]
    docs = [(i, " ".join(draw.choice(some) for _ in range(draw.randint(0, 60)))) for i in range(150)]
    docs += [(500, docs[3][1] + " more words than before")] * 90  # repeated rows
    docs += [(None, "no id " * 30), (7, None), (8, ""), (9, "--- ..."), (10, "z" * 5000), (11, "long one " * 20000)]
    target = [None, "", "the straße " * 10, "A1 9 a1"]
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    table = spark.createDataFrame(
        [(i, t, "k", 1, 1, "t") for i, t in docs], "doc_id long, text string, key string, rank int, weight int, tie string"
    )
    for percent in (5, 60, 100):
        assert sampled(resampling.resample(table, bench, percent)) == brute_sample(docs, target, percent)
    none = spark.createDataFrame([], "item_id string, text string")
    assert sampled(resampling.resample(table, none)) == brute_sample(docs, [])
    assert sampled(resampling.resample(table.limit(0), bench)) == Counter()


@pytest.mark.parametrize("pivots", [1, 3, 48])
def test_quickselect(spark, pivots):
    draw = random.Random(pivots)
    keys = [(draw.randint(-9, 9), draw.randint(0, 40)) for _ in range(400)] + [(3, 3)] * 200
    df = spark.createDataFrame([(k,) for k in keys], "key struct<far:long,id:long>").cache()
    for k in (1, 2, 300, 399, 600):
        key, before = resampling.quickselect(df, k, pivots=pivots)
        assert key == sorted(keys)[k - 1] and before == sum(x < key for x in keys)


def test_ranks_in_slices(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 50)
    keys = random.Random(1).sample(range(10000), 700)
    df = spark.createDataFrame([((k, 1), 0) for k in keys], "key struct<far:long,id:long>, tie int")
    got = {r.key.far: r["rank"] for r in resampling.ranked(df, 700).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_checksums():
    words = [b"a", b"", b"word" * 16, b"q" * 63, b"q" * 64, b"q" * 65, b"z" * 255, b"z" * 256, b"z" * 1000]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = resampling.checksums(data, ends - [len(w) for w in words], ends)
    assert got.tolist() == [zlib.crc32(w) for w in words]
    for a in words:
        n = np.array([len(b) for b in words])
        moved = resampling._moved(np.full(len(words), zlib.crc32(a), np.uint32), n) ^ got
        assert moved.tolist() == [zlib.crc32(a + b) for b in words]


# --- whitening ----------------------------------------------------------------------


def brute_whitening(rows):
    kept = [(i, e) for i, e in rows if e is not None and None not in e and np.isfinite(e).all()]
    width = Counter(len(e) for _, e in kept).most_common(1)[0][0]
    kept = [(i, np.floor(256 * np.float32(e).astype(float)).astype(int) + 0) for i, e in kept if len(e) == width]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, value[::-1], vector[:, ::-1]


def whitened(df):
    rows = df.collect()
    out = {}
    for r in rows:
        out.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    return rows, out


def check(df, rows):
    kept, n, sums, value, vector = brute_whitening(rows)
    rank = int((value > 1e-9 * value[0]).sum())
    got, by_row = whitened(df)
    assert len(got) == len(kept) * min(4, rank) and all(r.n == n and r.identity_error < 1e-9 for r in got)
    axes = {}
    for i, x in kept:
        own = by_row[i, sum(int(n * a - b) ** 2 for a, b in zip(x, sums, strict=True))]
        for c, r in own.items():
            e = value[c - 1]
            assert math.isclose(r.explained, e / value.sum(), rel_tol=1e-9)
            axes.setdefault(c, []).append((r.whitened, (x - sums / n) @ vector[:, c - 1] / np.sqrt(e)))
    for c, pairs in axes.items():
        alone = all(abs(value[c - 1] - v) > 1e-6 * value[0] for j, v in enumerate(value) if j != c - 1)
        a, b = np.array(pairs).T
        assert not alone or min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_whitening_of_odd_rows(spark):
    check(whitening.whiten(table(spark, odd_rows())), odd_rows())


@pytest.mark.parametrize(
    "rows",
    [
        [(i, [float(i == j) for j in range(6)]) for i in range(6)],  # equal eigenvalues
        [(i, [i / 8.0, i / 4.0, 1.0]) for i in range(9)],  # one direction
        [(i, [i % 3 / 2.0, i % 5 / 3.0]) for i in range(40)],  # two components only
        [(1, [4e8, -4e8, 1.0]), (2, [-4e8, 3e8, 2.0]), (3, [1e8, 3e8, 9.0])],  # sums of squares near a long
    ],
)
def test_whitening_of_small_spaces(spark, rows):
    if rows[0][1][0] != 4e8:
        check(whitening.whiten(table(spark, rows)), rows)
        return
    got = whitening.whiten(table(spark, rows)).collect()
    assert got and all(r.deviation is None for r in got)  # beyond the range of a long


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_bidiagonalisation_of_given_spectrum(spark):
    """Values that lie close, with many rows: singular values to double precision."""
    draw = np.random.default_rng(8)
    u, _ = np.linalg.qr(draw.normal(size=(400, 30)))
    v, _ = np.linalg.qr(draw.normal(size=(30, 30)))
    sigma = np.r_[1000.0, 999.5, 300.0, 299.0, np.linspace(250, 1, 26)]
    data = u * sigma @ v.T
    df = spark.createDataFrame([(r.tolist(),) for r in data], "x array<double>").repartition(5).cache()
    got, found = whitening.bidiagonalise(df, 30, np.zeros(30), 4)
    assert np.allclose(got, sigma[:4], rtol=1e-12)
    assert np.allclose(np.abs((found * v.T[:4]).sum(1)), 1, atol=1e-9)


def test_totals(spark):
    df = spark.range(0, 1000, 1, 7)
    total = vx.totals(df, lambda b: np.array([b.num_rows, sum(b.column("id").to_pylist())]), 2, np.int64)
    assert total.tolist() == [1000, 499500]
    assert ar.word_spans(np.array([0, 1, 1, 0, 1]), np.array([0, 2, 5]))[0].tolist() == [1, 2, 4]
