"""SimHash, lines, passages and embeddings against plain versions."""

import hashlib

import numpy as np
import xxhash
from plain import DOCS, components, documents, line_set, pairs, prose, repeated, words
from pyspark.sql import functions as F

from folioscope.llm import covertree, linededup, simhash, suffixdedup, suffixes
from folioscope.llm.common import Shared, compacted
from folioscope.llm.common import components as joined


def fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    want = components(500, links)
    for edges in (df, compacted(df)):
        got = dict(joined(Shared(spark), edges).collect())
        assert all(want[n] == c for n, c in got.items()) and set(got) == {n for a, b in links for n in (a, b) if a != b}
    assert joined(Shared(spark), df.limit(0)).count() == 0


def test_simhash(spark):
    near = [(100 + k, " ".join(w if i != k else "zz" for i, w in enumerate(prose(400, 50).split()))) for k in range(12)]
    rows = [(i, t) for i, t in pairs(documents())] + near
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    prints = [fingerprint(t) for _, t in rows]
    label = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        want.append((i, prints[k], min(ids, default=None)))
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == sorted(want, key=str)
    left = simhash.without_near_duplicates(spark.createDataFrame(documents(), DOCS).repartition(2), width=5)
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    texts = sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None)
    assert [i for i, _ in texts if i in (1, 8, 14)] == [1] and {2, 3, 7, 20} <= {i for i, _ in texts}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_lines(spark):
    line = prose(40, 77).replace("\n", " ")
    rows = [(i, t) for i, t in pairs(documents())] + [
        (200, f"{line}\n\nkeep me {line[:30]}\n  {line}  "), (201, line.replace("a", "b", 1) + "\nkeep\nkeep"), (202, f"short\nkeep\n{line.upper()}"), (203, line)]
    docs = spark.createDataFrame([(*r, "s", 5) for r in rows], "doc_id long, text string, h1 string, n_chars int").repartition(3)
    got = linededup.without_duplicates(docs)
    assert got.columns == ["doc_id", "text", "h1", "n_chars"]
    # the plain version, in order of doc_id with null ids last
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: r[:2])
    first, names = {}, []
    for none, i, t in order:
        for n, x in enumerate(t.split("\n")):
            x = x.strip(" ")
            if x and x not in first:
                names.append(x)
                first[x] = (none, i, n)
    sets = [line_set(x, linededup.WIDTH) for x in names]
    label = components(len(names), [(a, b) for a in range(len(names)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    place = {x: min(first[names[j]] for j in range(len(names)) if label[j] == label[k]) for k, x in enumerate(names)}

    def cut(i, t):
        return None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(" ") or place[x.strip(" ")] >= (i is None, i or 0, n))

    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(cut(i, t))) for i, t in rows)
    assert all(r.n_chars in (5, len(r.text or "")) for r in got.collect())
    assert linededup.without_duplicates(docs.limit(0)).count() == 0


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = rng.integers(0, rng.choice([1, 2, 4]), rng.integers(0, 40))
        text = np.tile(text, rng.integers(1, 4))
        stop = np.full(len(text), len(text))
        stop[:len(text) // 2] = len(text) // 2
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        order = suffixes.suffix_array(text, 4)
        assert order.tolist() == want
        common = suffixes.permuted_common_prefixes(text, order, stop)
        for j, i in zip(want, want[1:]):
            n = 0
            while n < min(stop[i] - i, stop[j] - j) and text[i + n] == text[j + n]:
                n += 1
            assert common[i] == n


def test_passages(spark, monkeypatch):
    common = prose(45, 31)
    rows = pairs(documents()) + [(300 + k, prose(12, 400 + k) + common + prose(12, 500 + k)) for k in range(40)] + [(90, "ab" * 300), (91, prose(90, 12) * 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, anchor int").repartition(3)
    raws, marks = repeated([t for _, t in rows], 100)
    want = sorted((str(i), bytes(x for x, m in zip(r, mark) if not m), sum(mark)) for (i, _), r, mark in zip(rows, raws, marks))
    for hot in (2000, 10):  # all by suffix arrays; and with anchors over the bound
        monkeypatch.setattr(suffixdedup, "HOT", hot)
        got = suffixdedup.repeated_passages(docs, 100).collect()
        assert sorted((str(r.doc_id), bytes(r.kept), sum(s.end - s.start for s in r.spans)) for r in got) == want
    assert suffixdedup.repeated_passages(docs.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()  # of an emptied text


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    v = [*base, *(base[rng.integers(0, 60, 80)] + rng.normal(size=(80, 8)) * rng.choice([0.0, 0.05, 0.2, 0.35], (80, 1))), *(base[:3] * 2.5)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] + [1.0] * 7), (504, [None] + [1.0] * 7), (505, [float("inf")] + [1.0] * 7),
                                                      (506, [1.0, 2.0]), (507, [2.0, 4.0]), (3, v[0].tolist()), (None, v[1].tolist())]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n string").repartition(3)
    got = covertree.near_duplicates(table, 0.9).collect()
    fine = [k for k, (_, x) in enumerate(rows) if x and None not in x and np.isfinite(x).all() and any(x)]
    cosine = {(a, b): float(np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1])) for a in fine for b in fine if a != b and len(rows[a][1]) == len(rows[b][1])}
    links = [p for p, c in cosine.items() if c >= 0.9]
    label = components(len(rows), links)
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        c = min(ids, default=None)
        want.append((i, sum(a == k for a, _ in links), c, i == c))
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(want, key=str)
    assert covertree.near_duplicates(table.limit(0)).count() == 0
    assert covertree.near_duplicates(table.where(F.col("vec_id") == 502)).collect()[0].n_links == 0


def test_embeddings_of_any_length(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(90, 6))
    v = np.concatenate([base, base[:60] + 0.2 * rng.normal(size=(60, 6))])
    scales = 10.0 ** rng.choice([-300, -200, -160, 0, 150, 200, 300], len(v))

    def links(rows):
        table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>").repartition(2)
        return sorted((r.vec_id, r.n_links, r.component_id) for r in covertree.near_duplicates(table, 0.9).collect())

    assert links(v * scales[:, None]) == links(v) and sum(n for _, n, _ in links(v)) > 60
