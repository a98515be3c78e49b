"""Candidates of the decontamination: sums of runs, and the bound on what is compared word by word."""

import numpy as np
from plain import prose

from folioscope.llm import decontamination as own


def test_sums_of_runs():
    rng = np.random.default_rng(3)
    size = np.array([1, 16, 17, 700, 2, 257])
    rows, index = rng.integers(0, 9, (50, 3)), rng.integers(0, 50, size.sum())
    want = [rows[x].sum(axis=0) for x in np.split(index, np.cumsum(size)[:-1])]
    assert np.array_equal(own._sums(rows, index, np.cumsum(size) - size), want)


def test_share_on_the_limit(spark):
    """A share of exactly 0.55 with the whole answer is found: 0.55 * 100 is more than 55 in binary."""
    first, last = [f"body{n}" for n in range(60)], [f"end{n}" for n in range(40)]
    around = [f"around{n}" for n in range(400)]
    docs = [(n, " ".join(around[:160] + first[:n] + last + around[160:])) for n in (14, 15)]
    # an item's words many times over are no item
    docs += [(3, " ".join(around[:160] + first[:30] * 9 + around[160:]))] + [(1000 + n, prose(100, 60 + n)) for n in range(20)]
    items = [(7, " ".join(first) + ". " + " ".join(last) + ".")]
    found = own.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.common, r.answer) for r in found.collect()] == [(15, 7, 0.55, 1.0)]
