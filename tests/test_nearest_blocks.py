"""All nearest vectors: what the blocks copy, and their rows."""

import numpy as np

from folioscope.operators import vectors as ve


def test_small_queries_at_once_do_not_make_small_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 8)).round(1)
    rows = spark.createDataFrame([(f"v{i:03}", [float(x) for x in r]) for i, r in enumerate(v)], "path string, vector array<double>")
    asked = rows.withColumnsRenamed({"path": "query_path", "vector": "query_vector"})
    copies = ve._blocked(rows, asked, 3, 600, 600, 10)._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, (1 - 1)" in copies or "sequence(0, 0" in copies
    score = v @ v.T
    want = sorted((f"v{i:03}", r + 1, f"v{j:03}") for i in range(600) for r, j in enumerate([j for j in np.lexsort((np.arange(600), -score[i].round(9))) if j != i][:3]))
    got = ve.nearest(asked, rows, 3, query_block=10).collect()
    by = {(r["query_path"], r["rank"]): r for r in got}
    assert len(got) == 1800 and all(abs(by[q, n]["score"] - score[int(q[1:]), int(p[1:])]) < 1e-5 for q, n, p in want)


def test_slices_of_rising_scores(spark, monkeypatch):
    """A slice that beats everything before it is cut as well."""
    monkeypatch.setattr(ve, "SLICE", 50)
    held = ve._Best(["q"], [np.array([1.0])], 3)
    held.add(np.array([f"p{i:04}" for i in range(400)], dtype=object), [np.array([float(i // 2)]) for i in range(400)])
    assert held.rows()["path"].tolist() == ["p0398", "p0399", "p0396"]
