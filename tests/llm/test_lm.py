"""The language model against a plain implementation of the same formulas."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import lm

SCHEMA = "doc_id long, text string, train boolean, score string, chunk int"
TEXTS = ["the cat sat on the mat", "The cat ran", "a dog sat on a mat", "the dog ran on the mat", "cat cat cat cat", "the cat sat on the mat", "a cat and a dog",
         None, "", "  ", "on the mat the dog sat and the cat ran", "mat mat dog the the the"]


def rows():
    held = [(i, t, True, "x", 7) for i, t in enumerate(TEXTS)]
    return held + [(20, "the zebra sat on the mat", False, None, None), (21, "cat zebra zebra", False, None, None), (21, "cat zebra zebra", False, None, None), (None, None, False, None, None)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


class Plain:
    def __init__(self, texts, order):
        self.order, self.counts, self.followers = order, [Counter() for _ in range(order)], [defaultdict(Counter) for _ in range(order)]
        for t in texts:
            seq = ["<s>"] * (order - 1) + words(t) + ["</s>"]
            for i in range(order - 1, len(seq)):
                for k in range(order):
                    gram = tuple(seq[i - k:i + 1])
                    self.counts[k][gram] += 1
                    self.followers[k][gram[:-1]][gram[-1]] += 1
        few = []
        for k in range(order):
            by = Counter(min(c, 7) for c in self.counts[k].values())
            few.append([by.get(i, 0) for i in range(8)])
        self.d = [lm.good_turing(np.array(f)) for f in few]
        self.n = sum(self.counts[0].values())

    def disc(self, k, c):
        return c * (self.d[k][c - 1] if c <= 5 else 1)

    def p(self, w, h):
        k = len(h)
        if k == 0:
            if self.counts[0][(w,)]:
                return self.disc(0, self.counts[0][(w,)]) / (self.n + lm.RESERVED)
            return 1 - sum(self.disc(0, c) for c in self.counts[0].values()) / (self.n + lm.RESERVED)
        seen = self.followers[k].get(h)
        if not seen:
            return self.p(w, h[1:])
        total = sum(seen.values()) + lm.RESERVED
        if seen[w]:
            return self.disc(k, seen[w]) / total
        left = 1 - sum(self.disc(k, c) for c in seen.values()) / total
        lower = 1 - sum(self.p(x, h[1:]) for x in seen)
        return left / lower * self.p(w, h[1:])

    def text(self, t):
        seq = ["<s>"] * (self.order - 1) + words(t) + ["</s>"]
        return sum(math.log10(self.p(seq[i], tuple(seq[i - self.order + 1:i]))) for i in range(self.order - 1, len(seq)))


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("parts", [1, 5])
def test_scores_and_sums(spark, order, parts):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(parts)  # a chunk for each part
    got, model = lm.katz_scores(docs, F.col("train"), order)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["score"], 9), r["n_tokens"], r["n_known"]) for r in got.collect())
    plain = Plain([t for _, t, use, _, _ in rows() if use], order)
    want = sorted((-1 if i is None else i, round(plain.text(t), 9), len(words(t)) + 1, sum(plain.counts[0][(w,)] > 0 for w in [*words(t), "</s>"])) for i, t, _, _, _ in rows())
    assert [x[:1] + x[2:] for x in found] == [x[:1] + x[2:] for x in want]
    assert all(abs(a[1] - b[1]) < 1e-7 for a, b in zip(found, want))
    vocabulary = [w for (w,) in plain.counts[0]]
    for h in list(plain.followers[order - 1])[:40]:
        assert abs(sum(plain.p(w, h) for w in [*vocabulary, "<unknown>"]) - 1) < 1e-9
    stored = model.ngrams().groupBy("order").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("c")).collect()
    assert {r["order"]: (r["n"], r["c"]) for r in stored} == {k + 1: (len(plain.counts[k]), plain.n) for k in range(order)}


def test_no_rows_and_no_training_texts(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert lm.katz_scores(docs.limit(0), F.col("train"))[0].count() == 0
    got = lm.katz_scores(docs.where("doc_id = 21"), F.lit(False))[0].collect()
    assert [(r["n_known"], r["score"]) for r in got] == [(0, 0.0)] * 2
