"""Near copies of documents against the Jaccard similarity of all pairs."""

import random

from plain import components, documents, pairs, prose, words
from pyspark.sql import functions as F

from folioscope.llm import neardocs


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Documents, and copies of them with single words changed, at similarities of 0.7 to 0.97."""
    rng, rows = random.Random(6), []
    for k in range(120):
        base = prose(rng.choice([150, 300, 600]), 6000 + k).split()
        copy = list(base)
        for n, i in enumerate(rng.sample(range(len(copy)), max(1, round(len(copy) * rng.choice([0.004, 0.01, 0.02, 0.03]))))):
            copy[i] = f"changed{k}n{n}"
        rows += [(1000 + 2 * k, " ".join(base)), (1001 + 2 * k, " ".join(copy))]
    return rows


def test_near_copies(spark):
    rows = pairs(documents()) + planted()
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    assert len([1 for a, b in links if 0.8 <= jaccard(sets[a], sets[b]) < 0.9]) >= 20 and len([1 for a, b in links if 0.9 <= jaccard(sets[a], sets[b]) < 0.97]) >= 20
    label = components(len(rows), links)
    want = []
    for k, (i, _) in enumerate(rows):
        want.append((i, min((rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None), default=None)))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    got = neardocs.near_copies(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)
    left = neardocs.without_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted({r.doc_id for r in left.where(F.col("doc_id") >= 1000).collect()}) == sorted({c for i, c in want if i is not None and i >= 1000 and c >= 1000})
    assert neardocs.near_copies(docs.limit(0)).count() == 0


def test_pipeline_stage(spark):
    import corpus_pipeline

    rows = planted()
    alike = {rows[k + 1][0] for k in range(0, len(rows), 2) if jaccard(shingles(rows[k][1]), shingles(rows[k + 1][1])) >= 0.8}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "").collect()}
    assert left == {i for i, _ in rows} - alike
