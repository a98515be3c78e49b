"""Recall of near-copy lines against the Jaccard similarity of their runs."""

import random

from plain import line_set, prose
from pyspark.sql import functions as F

from folioscope.llm import linededup


def stamped(n=150):
    """Pairs of lines of equal words behind different times, all at a similarity of 0.8 or more."""
    rng, out = random.Random(8), []
    while len(out) < n:
        body = prose(rng.randint(16, 30), 9000 + len(out)).replace("\n", " ") + f" {rng.random()}"
        pair = [f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {rng.randint(0, 23):02}:{rng.randint(0, 59):02} {body}" for _ in range(2)]
        a, b = (line_set(x, linededup.WIDTH) for x in pair)
        if 0.8 <= len(a & b) / len(a | b) < 1:
            out.append(pair)
    return out


def test_lines_with_other_numbers(spark):
    lines = stamped()
    docs = spark.createDataFrame([(k, "\n".join(p[k] for p in lines)) for k in range(2)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in linededup.without_duplicates(docs).collect()}
    assert left[0] == "\n".join(a for a, _ in lines)
    kept = [x for x in left[1].split("\n") if x]
    print(f"{len(lines) - len(kept)} of {len(lines)} found")
    assert len(kept) <= 0.05 * len(lines)


def test_runs_are_cut_by_place(spark):
    lines = ["short", "exactly8", "Nine chars", "É̀a x² 漢字 😀😀 GELDİ ok", "aaaaaaaaaaaa"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    spelled = rows.select("line", F.explode(linededup._spelled(F.col("line"))).alias("spelled"))
    cut = F.decode(F.substring("spelled.wide", F.col("at") * 4 + 1, F.col("spelled.size")), "UTF-32")
    runs = spelled.select("line", "spelled", F.explode(linededup._run_places("spelled")).alias("at")).select("line", cut.alias("run"), linededup._run_hash("spelled", F.col("at")).alias("h")).collect()
    for x in lines:
        assert {r.run for r in runs if r.line == x} == line_set(x, linededup.WIDTH)
    assert len({r.run for r in runs}) == len({r.h for r in runs}) == len({(r.run, r.h) for r in runs})


def edited(n=240, words=70):
    """Lines made from one by other words at 2 to 16 places: many near copies, many only related ones."""
    rng = random.Random(5)
    base = prose(words, 4242).replace("\n", " ").split()
    out = []
    for _ in range(n):
        line = list(base)
        for at in rng.sample(range(len(line)), rng.choice([2, 4, 8, 12, 16])):
            line[at] = "".join(rng.choice("abcdefgh") for _ in range(5))
        out.append(" ".join(line))
    return out


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    lines, compared, similar = edited(), [], linededup._similar

    def counted(pairs, texts):
        compared.append(pairs.count())
        return similar(pairs, texts)

    monkeypatch.setattr(linededup, "_similar", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    left = {r.doc_id for r in linededup.without_duplicates(docs).where("text != ''").collect()}
    sets = [line_set(x, linededup.WIDTH) for x in lines]
    label = list(range(len(lines)))
    linked = [(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in linked:
        low, high = sorted((label[i], label[j]))
        label = [low if x == high else x for x in label]
    print(f"{sum(compared)} compared, {len(linked)} linked, {len(set(label))} of {len(lines)} lines stay")
    assert left == set(label)
    assert sum(compared) <= 8 * len(lines)


def test_parities_differ_by_no_more_than_the_runs_of_one(spark):
    lines = edited(40) + ["short", "shorter", "aaaaaaaaaaaa", "aaaaaaaaaaaaaaaa"]
    found = {r.line_id: r for r in linededup._parities(spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")).collect()}
    sets = [line_set(x, linededup.WIDTH) for x in lines]
    assert [found[i].runs for i in range(len(lines))] == [len(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = sum(((found[i][f"p{k}"] ^ found[j][f"p{k}"]) % (1 << 64)).bit_count() for k in range(linededup.PARITIES))
            assert differ <= len(a ^ b) and (differ - len(a ^ b)) % 2 == 0
