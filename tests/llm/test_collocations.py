"""Collocations against plain counts, with budgets that extend prefixes to every level."""

import random
import re
from collections import Counter

import pytest
from plain import DOCS, documents

from folioscope.llm import collocations
from folioscope.llm.lm import opened


def plain(rows, least, top, share=80):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            c = counts.setdefault(lang, Counter())
            for k in range(1, 5):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        f = {p: x for p, x in c.items() if x >= least and len(p) > 1}
        gone = {p[i:i + k] for p, x in f.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * x >= share * c[p[i:i + k]]}
        rows_ = []
        for p, a in f.items():
            if p not in gone:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "x\u0085y", "rare%d" % seed, "b c", "\u0000", "日本"]
    out = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights=[30, 5, 20, 20, 9, 4, 2, 4, 3, 3], k=rng.randint(0, 80))
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in words))
    return out + ["new york city " * 40, "new york city", "a a a a a a a"]


@pytest.mark.parametrize("budget", [200_000, 400, 24])
def test_collocations(spark, monkeypatch, budget):
    monkeypatch.setattr(collocations, "EXTENDED", 1 << 40)
    rows = [(t, lang) for lang in ("en", "de", None, "und") for t in texts(len(str(lang)))] + [(r[1], r[2]) for r in documents()] + [(None, "fr"), ("", None), ("one two", "it")]
    df = spark.createDataFrame([(t, lang, 1, "z") for t, lang in rows], "text string, lang string, f int, w1 string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, least=5, top=25, budget=budget).collect()))
    assert got == plain(rows, 5, 25) and len({r[0] for r in got}) >= 3


def test_small_chunks_and_long_texts(spark, monkeypatch):
    rows = [(" ".join(texts(3, 900)), "en"), ("x" * 3_000_000 + " of the", "en"), ("of the", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(df, least=20, top=50).collect())) == plain(rows, 20, 50)
    chunks = list(collocations._suffixes(opened(collocations.squeezed(__import__("numpy").array([1, 2, -1, 3])), int), 4)[0].tolist())
    assert chunks == [[1, 2, -1, -1]]


def test_nothing(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, least=10_000).count() == 0
