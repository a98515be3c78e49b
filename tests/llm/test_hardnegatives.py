"""Hard negatives against plain integer products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import hardnegatives as hn


def plain(rows, step, positives, negatives):
    seen = []
    for at, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen.append((at, i, [math.floor(256 * x) for x in v], label))
    out = []
    for at, i, v, label in seen:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for _, j, w, other in seen if j != i and len(w) == len(v) and v)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(s, j) for s, j, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, pid, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit[:negatives])]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], int(rng.integers(0, 3))) for i in range(260)]
    rows += [(1000 + i, rows[5][1], i % 2) for i in range(40)]  # many equal vectors
    rows += [(2000, None, 1), (2005, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2010, [float("nan")] * 6, 0), (2015, [float("inf")] + [0.0] * 5, 0), (2020, [0.0] * 6, 0), (2025, [1.0] * 6, None),
             (2030, [], 1), (2035, [0.5, 0.5], 1), (2036, [0.5, 0.5], 1), (2037, [0.25, 0.25], 2), (None, [1.0] * 6, 1), (2040, [-1e-300] * 6, 2), (5, rows[6][1], 1)]
    return rows


@pytest.mark.parametrize("size", [1.0, 3e5, 3e9])
def test_hard_negatives(spark, monkeypatch, size):
    monkeypatch.setattr(hn, "CANDIDATES", 97)
    monkeypatch.setattr(hn, "ANCHORS", 19)
    rows = [(i, None if v is None else [x if x is None else x * size for x in v], label) for i, v, label in vectors()]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, anchor string").repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, 5, 5, 10)
    if size == 3e9:  # some scores pass 64 bits: they are ranked, but no long holds them
        want = [(*w[:4], *(s if abs(s) < 1 << 63 else None for s in w[4:])) for w in want]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 500


def test_fields():
    rng = np.random.default_rng(2)
    for top in (1, 300, 1 << 20, 1 << 29, 1 << 40):
        x, a = rng.integers(-top, top + 1, (50, 7)), rng.integers(-top, top + 1, 7)
        got = hn.Packed(x, top + 1).scores(a)
        assert [int(s) for s in got] == [sum(int(p) * int(q) for p, q in zip(row, a)) for row in x]


def test_nothing(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hn.hard_negatives(df, F.col("vec_id") < 0).count() == 0
