"""A passage in very many texts: what its shards tell each other."""

import random

from plain import repeated

from folioscope.llm import suffixdedup


def test_strings_found_in_a_shard_do_not_meet_again(spark, monkeypatch):
    """Regions around one anchor, in more shards than one: only strings that a shard holds once go back to it."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(40)]
    texts = []
    for _ in range(300):
        line = list(base)
        for at in rng.sample(range(len(line)), 2):
            line[at] = word()
        texts.append(" ".join(line))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back, put = {}, suffixdedup.Shared.put

    def counted(self, name, df):
        out = put(self, name, df)
        if name == "strings":  # one row for each start
            told = out.where("n > 0")
        elif name == "sorted":
            told = out.where("string is not null")
        else:
            return out
        often = told.groupBy("string").count().where("count > 1")
        back["rows"] = told.where("a >= 0").join(often, "string").count()
        return out

    monkeypatch.setattr(suffixdedup, "HOT", 100)
    monkeypatch.setattr(suffixdedup.Shared, "put", counted)
    got = {r.doc_id: bytes(r.kept) for r in suffixdedup.repeated_passages(docs, 100).collect()}
    raws, marks = repeated(texts, 100)
    starts = sum(max(0, len(t) - 99) for t in texts)
    print(f"{back['rows']} of {starts} starts go back")
    for i, (raw, mark) in enumerate(zip(raws, marks)):
        assert got[i] == bytes(x for x, m in zip(raw, mark) if not m)
    assert back["rows"] < starts / 10
