"""Packing and token files: exact round trips."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from plain import DOCS, documents, pairs, prose

from folioscope.llm import packing, tokenfiles
from folioscope.llm.catalog import tokenizer
from folioscope.llm.tokens import CLOSE, PIECE, PieceEncoder, encoder, piece_starts
from folioscope.session import work_dir


def plain_ids(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return [x.ids + [end] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_tokenizers_ids(name):
    texts = [t for _, t in pairs(documents())] + ["a\n\n b  c\n", "don't   stop's\t\tx", "É̀a x²y 12ab,foo;bar  ", "\x1c\x1d a\x85b", "é,", "we'LL 'S", "a.b!c?d", "　x  y"]
    texts += ["a <|endoftext|> b", "x<|endoftext|><|startoftext|>y.", "<|ENDOFTEXT|>", "GELDİ, ok", "İ, İ.", "aİ, b", "<|endoftext|>" * 3]
    rng = random.Random(11)
    parts = ["İ", "ı", "ß", "ſ", "é", "e\u0301", "A", "b", "'s", "'LL", ",", ".", "!", " ", "  ", "\n", "\t", "\xa0", "12", "²", "漢", "<|endoftext|>", "<|", "|>", "Ǆ", "ŉ", "\u0345", "ﬁ", "😀"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(6000)]
    code = PieceEncoder(tokenizer(name))
    for _ in range(2):  # fresh, then remembered
        ids, offsets, _ = code.encode(texts, 7)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == plain_ids(name, texts, 7)
    assert code.encode([], 7)[0].tolist() == []


def test_cuts_of_a_batch_are_the_patterns():
    rng = random.Random(12)
    parts = ["İ", "ß", "e\u0301", "A", "b", "'s", ",", ".", "!", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\u2009", "12", "²", "漢", "😀", "\u3001", "\x00", "\x85", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20000)]
    data = CLOSE.join([*(t.encode() for t in texts), b""])
    starts = piece_starts(np.frombuffer(data, np.uint8)).tolist()
    assert [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])] == [p for t in texts for p in [*(x.encode() for x in PIECE.findall(t)), CLOSE]]


def test_a_worker_encodes_in_its_own_thread(monkeypatch):
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    encoder(tokenizer("byte_bpe_50k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


@pytest.mark.parametrize("length", [1024, 40, 16, 3])
def test_packing(spark, length):
    docs = spark.createDataFrame(documents(), DOCS).repartition(3)
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json"), length).collect()
    want = sorted(((i is not None, i), ids) for (i, _), ids in zip(pairs(documents()), plain_ids("byte_bpe_50k.json", [t for _, t in pairs(documents())], 0)))
    rows, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        rows[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for held in sequences.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= length
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in want)
    for (_, i), ids in want:
        if i is not None and i < 20:
            mine = sorted(rows[i], key=lambda p: p.start)
            assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
            assert all(p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start:p.start + p.length]) for p in mine) and sum(p.length for p in mine) == len(ids)
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        places = np.cumsum(rng.integers(1, 6, rng.integers(1, 12)))
        costs, length = rng.integers(0, 5, len(places)), int(rng.integers(6, 14))
        best = {0: 0}
        for k, c in enumerate(places.tolist()):
            best[c] = min(best[p] + length - (c - p) + costs[k] for p in best if c - p <= length)
        cuts = packing.best_cuts(places, costs, length).tolist()
        spent = sum(length - (b - a) + costs[places.tolist().index(b)] for a, b in zip([0, *cuts], cuts))
        assert cuts[-1] == places[-1] and spent == best[int(places[-1])]


def test_little_padding(spark):
    docs = spark.createDataFrame([(i, prose(300 + i % 50, i)) for i in range(400)], "doc_id long, text string")
    row = packing.padding(packing.pack(docs, tokenizer("byte_bpe_50k.json"), partitions=1)).first()
    assert row.padding < 0.02 * row.tokens


def test_token_files(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(documents(), DOCS).repartition(3)
    folder = f"{work_dir(spark)}/tokens"
    files = tokenfiles.write_token_files(docs, tokenizer("word_bpe_49k.json"), folder, end_id=2, length=64, file_tokens=500)
    got = tokenfiles.read_token_files(spark, folder, files).orderBy("start").collect()
    rows = pairs(documents())
    coded = {}
    for (i, _), ids in zip(rows, plain_ids("word_bpe_49k.json", [t for _, t in rows], 2)):
        coded.setdefault(i, []).append(ids)
    start = 0
    for r in got:
        assert r.start == start and any(len(x) == r.n_tokens and crc(x) == r.ids_crc32 for x in coded[r.doc_id])
        start += r.n_tokens
    assert len(got) == len(rows) and files.count() > 3
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i)
    # random access to a sequence is a view of the mapped file
    first = files.orderBy("first_token").first()
    ids, mask = tokenfiles.sequence(f"{folder}/{first.file}", 0)
    assert ids.base is not None and len(ids) == len(mask) == 64 and not ids.flags.owndata
    with pa.memory_map(f"{folder}/{first.file}") as source:
        assert sum(len(x) for _, _, x in tokenfiles.documents_in(source)) == first.n_tokens


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0
    folder = f"{work_dir(spark)}/tokens"
    assert tokenfiles.read_token_files(spark, folder, tokenfiles.write_token_files(none, tokenizer("word_bpe_49k.json"), folder, end_id=2)).count() == 0
