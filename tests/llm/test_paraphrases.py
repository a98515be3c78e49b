"""Paraphrases that keep 55 to 75 % of an item, against every passage compared."""

import random

from plain import prose

from folioscope.llm import decontamination as own


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_paraphrases(spark):
    rng, items, rows, single = random.Random(4), [], [], set()
    for i in range(40):
        body = [w.strip(".,!\n") for w in prose(32, 7000 + i).split()]
        rare = [f"rare{i}n{n}" for n in range(8)]
        for n, at in enumerate(sorted(rng.sample(range(24), 8))):
            body[at] = rare[n]
        if i % 2:
            single.add(i)
            items.append((i, " ".join(body) + "."))
        else:
            items.append((i, " ".join(body[:24]) + ". " + " ".join(body[24:]) + "."))
        # one-sentence items keep their rare words; of the others those are what is changed
        fixed = {k for k, w in enumerate(body) if (w in rare if i % 2 else k >= 24)}
        free = [k for k in range(32) if k not in fixed]
        gone = set(sorted(free, key=lambda k: body[k] not in rare if not i % 2 else rng.random())[:13])
        text = [f"other{k}" if k in gone else w for k, w in enumerate(body)]
        around = prose(300, 8000 + i).split()
        at = 8 + 16 * rng.randrange(8)
        rows.append((i, " ".join(around[:at] + text + around[at:])))
    rows += [(1000 + k, prose(400, 8500 + k)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.item_id) for r in own.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for (d, text), (i, item) in zip(rows, items):
        have, asked = own.words(text), own.words(item)
        assert 0.55 <= plain_common(asked, have) / len(asked) < 0.75
        answer = [w for w in asked if w.startswith("rare")] if i in single else own.answer_of(item)
        if plain_common(answer, have) >= 0.8 * len(answer):
            want.add((d, i))
    print(f"{len(found & want)} of {len(want)} found, of one sentence {len([p for p in found & want if p[1] in single])} of {len(single)}")
    assert len(want) == 40 and found == want
