"""Packing: ids like the tokenizer's, cuts like plain dynamic programming, every id in one piece."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from quitanda.llm import packing, queries, units

SF = "/root/testdata/sf0.01"
BYTES_FILE = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "A  b\n\nC", "a \n b", "a  \nb", "\n x", "\n\n x", "\n\n\nx", " \nx", "x\n", "x\n\n", "x ", "x  ", "don't I'LL we've 's",
       "e\u0301 a\u00a0b\u2003c\td\re\x0bf\x1cg\u0085i", "<|endoftext|> x<|start", "日本語 テスト 12345", "x" * 3000,
       "A.B, C., D,. E.\n'S, don'T. 1. 2, é, ñ. x.", "🙂🙂👩\u200d👩 ok", "a.'s b.\"c\" d!? e:f;g"]


@pytest.fixture(scope="module")
def encoder():
    return packing.encoder_of(BYTES_FILE)


def plain_ids(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_parts_encode_like_whole_texts(encoder, monkeypatch):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 40)))
                   for letters in ("aBS'te\u0301 \n\t.,.,1!\"? -\r\x1c", "ab \n.'", "a\u2003 \n\u00a0b") for _ in range(500)]
    for stretch in (1 << 20, 30):
        monkeypatch.setattr(units, "STRETCH", stretch)
        counts, flat = encoder.encode([t.encode() for t in texts])
        ends = np.cumsum(counts)
        assert [flat[e - c:e].tolist() for c, e in zip(counts, ends)] == plain_ids(encoder, texts)


def plain_cost(where, price, size):
    best = [0.0] * len(where)
    for j in range(1, len(where)):
        best[j] = price[j] + min(best[i] + packing.window_cost(where[j] - where[i], size)
                                 for i in range(j) if where[j] - where[i] <= size)
    return best[-1]


def test_cuts_cost_as_little_as_any():
    rng = random.Random(4)
    for _ in range(200):
        size = rng.choice([8, 16, 32])
        where = np.cumsum([0, *rng.choices(range(1, size + 1), weights=[3] + [1] * (size - 1), k=rng.randint(1, 60))])
        price = np.array([0.0, *rng.choices([0.0, packing.SENTENCE, packing.INSIDE], k=len(where) - 1)])
        cuts = packing.best_cuts(where, price, size)
        begin = [0, *cuts[:-1]]
        cost = sum(price[b] + packing.window_cost(where[b] - where[a], size) for a, b in zip(begin, cuts))
        assert cuts[-1] == len(where) - 1 and cost == plain_cost(where.tolist(), price.tolist(), size)


def test_borders():
    where, price = packing.borders(np.array([5, 400]), np.array([3]))
    assert where.tolist() == [0, 3, 5, *range(69, 400, 64), 400] and price[1:3].tolist() == [4.0, 0.0] and price[-1] == 0
    assert np.diff(where).max() <= 2 * packing.GRID


def whole(pieces, size):
    """{doc row: ids}, after checks that pieces and sequences have no gaps; rows in order of sequence."""
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append(r)
    docs, current = [], None
    for _, rows in sorted(sequences.items()):
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4 > 0
            at += r["length"]
            if r["start"] == 0:
                current = [r["doc_id"], r["doc_tokens"], []]
                docs.append(current)
            assert current[0] == r["doc_id"] and len(current[2]) == r["start"]
            current[2] += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert at <= size
    assert all(len(ids) == total for _, total, ids in docs)
    return [(doc, ids) for doc, _, ids in docs]


@pytest.mark.parametrize("size, block", [(2048, 2_000_000), (64, 100), (8, 1)])
def test_every_id_is_in_one_piece(spark, rows, encoder, size, block):
    data = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, None), (3, None), (50, "one. two! three?\n" * 300), (51, "w" * 9000)]
    frame = rows([(*d, 1, 2) for d in data], "doc_id long, text string, offset int, ids int").repartition(3)
    got = whole(packing.pack(frame, BYTES_FILE, size=size, block=block).collect(), size)
    want = [(i, [*ids, 1]) for (i, _), ids in zip(data, plain_ids(encoder, [t for _, t in data]))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert packing.pack(frame.limit(0), BYTES_FILE).collect() == []


def test_query_digests_all_documents_with_little_padding(spark, encoder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.packed_windows(spark, SF).collect()
    want = dict(zip(docs, plain_ids(encoder, docs.values())))
    lengths = defaultdict(int)
    for r in got:
        ids = [*want[r["doc_id"]], 1]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
        lengths[r["sequence_id"]] += r["length"]
    assert sum(lengths.values()) == sum(len(i) + 1 for i in want.values())
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert padding < 0.01 * sum(lengths.values())
