import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from moodlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA).repartition(3)


def table(spark, rows):
    df = frame(spark, rows)
    model = whitening.fit(df)
    return model, whitening.long_form(whitening.transform(df, model, keep=["vec_id"]), model).collect()


def brute(rows):
    """n, integers by id, exact deviations by id, covariance (of fractions rounded once)."""
    ok = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(ok), len(ok[0][1])
    s = [sum(x[k] for _, x in ok) for k in range(d)]
    dev = [sum((n * x[k] - s[k]) ** 2 for k in range(d)) for _, x in ok]
    cov = [[float(sum((x[a] - Fraction(s[a], n)) * (x[b] - Fraction(s[b], n)) for _, x in ok) / n) for b in range(d)]
           for a in range(d)]
    return n, ok, s, dev, np.array(cov)


def check(rows, model, got, components):
    n, ok, s, dev, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * components and {r["n"] for r in got} == {n}
    by_id = {(r["vec_id"], r["component"]): r for r in got}
    for (i, x), d in zip(ok, dev):
        centred = np.array([float(v - Fraction(t, n)) for v, t in zip(x, s)])
        for c in range(components):
            r = by_id[i, c + 1]
            assert r["deviation"] == d
            assert abs(r["explained"] / (values[c] / np.trace(cov)) - 1) < 1e-9
            assert abs(abs(r["whitened"]) - abs(centred @ vectors[:, c]) / math.sqrt(values[c])) < 1e-6
    for c in range(components):                                 # one sign for all rows
        signs = {np.sign(by_id[i, c + 1]["whitened"] * (np.array([float(v - Fraction(t, n)) for v, t in zip(x, s)]) @ vectors[:, c]))
                 for i, x in ok} - {0.0}
        assert len(signs) == 1
    assert {r["identity_error"] for r in got} == {model.identity_error} and model.identity_error < 1e-8


def test_equals_fractions(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(120, 10)) @ rng.normal(size=(10, 10)) + 3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(mixed)]
    bad = [(500, None), (501, [1.0, None] + [0.0] * 8), (502, [float("nan")] * 10), (503, [float("-inf")] + [0.0] * 9)]
    model, got = table(spark, rows + bad)
    check(rows + bad, model, got, 8)


def test_far_apart_values_are_exact(spark):
    """Squares that leave 64 bits: the tasks go on with Python integers, a deviation beyond a long is null."""
    rows = [(i, [float(2 ** 40 * (i % 3)), float(i), -1.0 * 2 ** 30 * (i % 5), 1.0 * (i * i % 7)]) for i in range(40)]
    df = frame(spark, rows)
    model = whitening.fit(df)
    n, ok, s, dev, cov = brute(rows)
    assert [int(c) * n + r for c, r in zip(model.centre, model.rest)] == s
    sums, width = whitening._vectors(df, "embedding")
    squares = whitening._exact_sums(sums, width, "embedding", whitening._squares(model.centre))
    z = [[v - int(c) for v, c in zip(x, model.centre)] for _, x in ok]
    assert squares == [sum(x[a] ** 2 for x in z) for a in range(4)] + \
        [sum((x[a] + x[b]) ** 2 for x in z) for a, b in zip(*np.triu_indices(4, 1))]
    got = {r["vec_id"]: r["deviation"] for r in whitening.transform(df, model).collect()}
    assert got == {i: d if d < 2 ** 63 else None for (i, _), d in zip(ok, dev)} and None in got.values()
    assert np.allclose(model.variances[:1], np.linalg.eigvalsh(cov)[::-1][:1], rtol=1e-12)


def test_repeated_rows_null_ids_and_few_dimensions(spark):
    rows = [(1, [0.5, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (None, [0.25, 3.0, 1.0]), (2, [4.0, 0.0, 0.0]), (3, [1.0, 1.0, 7.0]),
            (4, [1.0]), (5, [])]
    model, got = table(spark, rows)
    assert model.n == 5 and len(got) == 15 and sum(r["vec_id"] is None for r in got) == 3
    assert len({(r["component"], r["whitened"]) for r in got if r["vec_id"] == 1}) == 3


def test_no_variance(spark):
    model, got = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(0, None, 0.0, None)] * 4
    rank_one, got = table(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])
    assert {r["component"] for r in got if r["whitened"] is None} == {2} and rank_one.identity_error < 1e-9


def test_no_rows(spark):
    for rows in ([], [(1, None), (2, []), (3, [float("nan")])]):
        model, got = table(spark, rows)
        assert model is None and got == []


def test_all_columns_are_kept(spark):
    df = frame(spark, [(i, [float(i), float(i * i)]) for i in range(5)])
    out = whitening.transform(df, whitening.fit(df))
    assert out.columns == ["vec_id", "embedding", "row", "deviation", "whitened"]
    assert out.filter(F.size("whitened") == 2).count() == 5
