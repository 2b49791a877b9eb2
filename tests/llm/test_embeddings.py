"""Near-duplicates, whitening and clustering of embeddings against brute force."""

import hashlib
import math

import numpy as np
import pytest
from oracle import rows_of, rows_of_sql
from pyspark.sql import functions as F

from passagekit.llm import lloyd, pq_dedup, whitening
from passagekit.llm.queries import ORACLE_SQL, QUERIES

KIND = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def planted(rng, n, dim=64):
    """Random directions, some close copies of each other (around the threshold too), some equal, of any length."""
    x = rng.standard_normal((n, dim))
    for k in range(0, n // 3, 3):
        away = rng.choice([0.0, 0.05, 0.15, 0.19, 0.2, 0.21, 0.3])
        side = rng.standard_normal(dim)
        side -= x[k] * (side @ x[k]) / (x[k] @ x[k])
        x[k + 1] = x[k] + away * side * np.linalg.norm(x[k]) / np.linalg.norm(side)
    x *= rng.uniform(0.5, 2, (n, 1))
    hot = rng.standard_normal(dim)
    x[-n // 5 :] = hot + 0.02 * rng.standard_normal((n // 5, dim))
    return x.astype(np.float32)


def odd_rows():
    x = [0.25] * 64
    return [
        (9001, None, 1), (9002, [], 1), (9003, [0.0] * 64, 1), (9004, [None, *x[1:]], 1), (9005, [NAN, *x[1:]], 1), (9006, [INF, *x[1:]], 1),
        (9007, x, None), (9008, x, 1), (9008, x, 1), (9008, [-v for v in x], 1), (9009, [1.0, 2.0], 1), (9010, [2.0, 4.0], 1), (None, x, 1),
    ]


def table(spark, x, labels, more=()):
    rows = [(int(i), [float(v) for v in row], int(labels[i])) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, *more], KIND)


def brute_links(rows, cosine=0.98):
    """n_links and component_id of each row, by comparing all pairs."""
    n = len(rows)
    sound = [r[1] is not None and len(r[1]) > 0 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]) and r[2] is not None for r in rows]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) if s else None for r, s in zip(rows, sound, strict=True)]
    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("cells", "chunk"), [(None, 2048), (1, 64), (40, 32)])
def test_pq_dedup_finds_every_link(spark, cells, chunk):
    rng = np.random.default_rng(3)
    df = table(spark, planted(rng, 700), rng.integers(0, 3, 700), odd_rows())
    got = pq_dedup.near_duplicates(df.withColumns({"node": F.lit("clash"), "h": F.lit(1), "cell": F.lit(2)}), cells=cells, chunk=chunk)
    want = brute_links([tuple(r) for r in df.collect()])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert max(w[1] for w in want) > 30


def test_pq_dedup_small_sample(spark):
    """Quantisers fitted on a handful of vectors cost time, not links."""
    rng = np.random.default_rng(4)
    df = table(spark, planted(rng, 300, 7), rng.integers(0, 2, 300))
    got = pq_dedup.near_duplicates(df, sample=20, cells=8)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_links([tuple(r) for r in df.collect()])


def test_pq_dedup_bounds():
    """No link lies outside the probed lists or beyond the looked-up distance."""
    rng = np.random.default_rng(5)
    x = planted(rng, 2000).astype(np.float64)
    model = pq_dedup.train(x[:500], 24, 4, 16)
    cell, away, code, err = pq_dedup.encode(model, x)
    least, most = np.full(24, 9.0), np.full(24, -9.0)
    np.minimum.at(least, cell, away)
    np.maximum.at(most, cell, away)
    row, target = pq_dedup.probes(model, x, cell, least, most, 0.2)
    asked = set(zip(row.tolist(), target.tolist(), strict=True))
    u = pq_dedup.unit(x)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
    assert len(a) > 1000
    for i, j in zip(a, b, strict=True):
        i, j = (i, j) if cell[i] >= cell[j] else (j, i)
        assert (i, cell[j]) in asked
        assert pq_dedup.lookup(model, int(cell[j]), x[i : i + 1], code[j : j + 1])[0, 0] <= 0.2 + err[j] + pq_dedup.SLACK
    assert len(asked) < 0.9 * len(x) * 12.5  # and not every list is probed


def test_pq_dedup_empty(spark):
    empty = spark.createDataFrame([], KIND)
    assert pq_dedup.near_duplicates(empty).collect() == []
    only = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], KIND)
    assert sorted(map(tuple, pq_dedup.near_duplicates(only).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def usable(rows, dim=64):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(v is not None and math.isfinite(v) for v in r[1])]


def test_whitening(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 64)) * np.linspace(2, 0.2, 64) @ np.linalg.qr(rng.standard_normal((64, 64)))[0]
    x[500:] = x[0]
    df = table(spark, x, np.zeros(900), odd_rows())
    model = whitening.fit(df.withColumn("x", F.lit("clash")))
    rows = usable([tuple(r) for r in df.collect()])
    ints = np.array([[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in rows])
    kinds = np.unique(ints, axis=0)
    v = np.cov(kinds.T.astype(np.float64), bias=True)
    e, y = np.linalg.eigh(v)
    e, y = e[::-1][:16], y[:, ::-1][:, :16]
    assert (model.n, model.sums) == (len(kinds), kinds.sum(axis=0).tolist())
    assert np.allclose(model.values, e, rtol=1e-12) and model.trace == pytest.approx(np.trace(v)) and model.residual < 1e-10 * e[0]
    assert np.abs(np.abs(np.einsum("dm,dm->m", model.directions, y)) - 1).max() < 1e-10
    got = whitening.whiten(df.withColumn("component", F.lit(0)), model).collect()
    assert len(got) == 16 * len(rows) and model.identity_error < 1e-9
    sign = np.sign(np.einsum("dm,dm->m", model.directions, y))
    centre = kinds.mean(axis=0)
    by_id = {}
    for r in got:
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    for k in (0, 3, 450, 899):
        dev = sum((len(kinds) * int(a) - int(s)) ** 2 for a, s in zip(ints[k], kinds.sum(axis=0), strict=True))
        for c in range(16):
            (r,) = by_id[rows[k][0], c + 1]
            assert (r["n"], r["deviation"]) == (len(kinds), dev)
            assert r["whitened"] == pytest.approx(float((ints[k] - centre) @ y[:, c] / math.sqrt(e[c]) * sign[c]), abs=1e-9)
            assert r["explained"] == pytest.approx(e[c] / np.trace(v)) and r["identity_error"] == model.identity_error


def test_lobpcg_needs_more_passes_than_a_wide_block():
    """A dimension far above the block: the iteration proper, with clusters of eigenvalues."""
    rng = np.random.default_rng(7)
    d = 300
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.r_[np.full(4, 10.0), np.linspace(9, 8, 12), np.linspace(7.5, 0, d - 16)]
    v = (q * e) @ q.T
    values, y, size, passes = whitening.leading(lambda b: v @ b, d, 16, 8, 1e-13, 500, 1)
    assert np.allclose(values, e[:16], rtol=1e-12) and size.max() < 1e-9 and 5 < passes < 200
    assert np.allclose(y.T @ y, np.eye(16), atol=1e-12)
    with pytest.raises(ArithmeticError):
        whitening.leading(lambda b: v @ b, d, 16, 8, 1e-13, 3, 1)


def test_whitening_small_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, None, 0)], KIND)
    assert whitening.whiten(one, whitening.fit(one)).collect() == []  # no variance
    line = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0), (3, [3.0, 1.0], 0), (4, [3.0, 1.0, 1.0], 0)], KIND)
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(1, 1), (2, 1), (3, 1)] and all(r["explained"] == pytest.approx(1.0) for r in got)
    far = spark.createDataFrame([(1, [0.0], 0), (2, [2.0**33], 0)], "vec_id long, embedding array<double>, label int")
    assert {r["deviation"] for r in whitening.whiten(far, whitening.fit(far)).collect()} == {None}  # (2 * 2**38) ** 2 is no long


def brute_lloyd(rows, k, rounds):
    x = [[math.floor(64 * v) for v in r[1]] for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x[i]))
    cents = [x[i] for i in order[:k]]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents] for v in x]
        return [min(range(len(cents)), key=lambda c: (r[c], c)) for r in d], [min(r) for r in d]

    for _ in range(rounds):
        own, _ = assign()
        for c in set(own):
            mine = [x[i] for i in range(len(x)) if own[i] == c]
            cents[c] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    own, d = assign()
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((r[0], own[i], d[i], sum(e for e, o in zip(d, own, strict=True) if o == own[i]), sum(d), name[own[i]]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("n", "k", "rounds"), [(220, 16, 3), (5, 16, 2), (60, 3, 0)])
def test_lloyd(spark, n, k, rounds):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x[: n // 2] = x[0]  # ties and empty clusters
    df = table(spark, x, np.zeros(n), odd_rows())
    got = lloyd.cluster(df.withColumn("cluster", F.lit("clash")), k=k, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == brute_lloyd(usable([tuple(r) for r in df.collect()]), k, rounds)


def test_lloyd_limits(spark):
    assert lloyd.cluster(spark.createDataFrame([], KIND)).collect() == []
    with pytest.raises(Exception, match="component too large"):
        lloyd.cluster(spark.createDataFrame([(1, [1e9] * 64, 0)], KIND)).collect()


@pytest.mark.parametrize("name", ["op11_pq_dedup", "op13_lloyd"])
def test_queries_sql(spark, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_of_sql(ORACLE_SQL[name], sf)


def test_op12_types(spark, sf):
    got = QUERIES["op12_whitening"](spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert got.count() == 16 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9
