"""The neighbour graph and its search against all products."""

import math

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import neighbours as nb


def plain(rows, step, k):
    fit = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in fit]
    usual = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0
    fit = [(i, v) for i, v in fit if len(v) == usual]
    out = {}
    for i, v in fit:
        if i % step == 0:
            out[i] = sorted(((-float(v @ w), j) for j, w in fit if j != i))[:k]
    return out


def check(spark, rows, step, k, recall, tolerance=1e-9):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, node string, home int").repartition(3)
    got = {}
    for r in nb.nearest(df, df.where(F.col("vec_id") % step == 0), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain(rows, step, k)
    assert set(got) == {q for q, near in want.items() if near}
    hit = total = 0
    for q, near in want.items():
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(near) + 1)) and q not in [m[1] for m in mine]
        assert [(-round(m[2], 9), m[1]) for m in mine] == sorted((-round(m[2], 9), m[1]) for m in mine)
        hit += len({m[1] for m in mine} & {j for _, j in near})
        total += len(near)
    assert hit >= recall * total, (hit, total)


def test_recall(spark, monkeypatch):
    for name, value in {"START_BLOCK": 64, "START_BEST": 8, "DEGREE": 16, "SAMPLE": 8, "BLOCK_BYTES": 1 << 21, "POOL": 64, "STEP": 8, "PART": 9}.items():
        monkeypatch.setattr(nb, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    points = centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    check(spark, [(i, p.tolist()) for i, p in enumerate(points * rng.uniform(0.5, 2, (1500, 1)))], 20, 10, 0.9)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(70)]  # very many equal vectors: ties go to smaller ids
    rows += [(300, None), (305, [1.0, None, 0.0, 0.0]), (310, [math.nan] * 4), (315, [math.inf, 0.0, 0.0, 0.0]), (320, [0.0] * 4), (325, []), (330, [1.0, 2.0]), (None, [1.0] * 4), (5, rows[6][1])]
    check(spark, [r for r in rows if r[0] != 5], 5, 20, 1.0)
    check(spark, [(i, [1e-250 * x for x in v] if v and None not in v else v) for i, v in rows if i != 5], 5, 6, 0.0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert nb.nearest(df, df.where("vec_id = 5"), 3).where("vec_id = 5").count() == 0
    assert nb.nearest(df.limit(0), df, 3).count() == 0 and nb.nearest(df, df.limit(0), 3).count() == 0
    assert nb.nearest(df.where("vec_id = 1"), df, 3).count() == 0


def test_homes(spark):
    ids = [0, 1, -5, 7, 1 << 40, -(1 << 62), 123456789]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.xxhash64("i"), F.lit(13))).collect()
    assert [r[0] for r in got] == nb.home_of(np.array(ids), 13).tolist()
