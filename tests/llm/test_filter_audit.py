"""Filter audit against filters applied one after the other."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from quitanda.llm import filter_audit, queries
from tests.oracle import connect, difference


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        earlier = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs)
        rows.append((lang or "", i, fails(text) | {"E": earlier}))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[2][f]]
                left = [r for r in left if not r[2][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[2][f] for r in mine) - len(gone),
                    sum(r[2][f] and sum(r[2].values()) == 1 for r in mine),
                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_orders_equal_brute_force(spark, rows):
    rng = random.Random(2)
    docs = []
    for i in range(160):
        if docs and rng.random() < 0.3:
            text = rng.choice(docs)[1]
        else:
            kinds = rng.choice([3, 90, 110, 300])
            text = rng.choice([" ", "\n", "\t "]).join(rng.choice(["w", "W", "É", "日"]) + str(rng.randrange(kinds)) for _ in range(rng.choice([0, 1, 99, 100, 130])))
            text = text + rng.choice(["", "", " #", " |", "LOUD" * 30])
        docs.append((i, text, rng.choice(["en", "de", None, ""])))
    docs += [(500, None, "en"), (501, "", "en"), (None, docs[0][1], "en"), (None, None, "xx"), (7, docs[7][1], docs[7][2]), (3, "second text", "de"),
             (600, "long " * 100_000, "yy"), (10**12, "Ünï " * 200, "yy"), (-5, docs[1][1], "zz")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (9_999, 1, 1), (500, 1, 0)]
    frame = rows([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, fails int, part string")
    got = filter_audit.audit(frame, rows([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, first int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == brute(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_empty_tables(spark, rows):
    none = rows([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(rows([], "doc_id long, text string, lang string"), none).collect() == []
    got = filter_audit.audit(rows([(1, "a b", "en")], "doc_id long, text string, lang string"), none).collect()
    assert len(got) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000, 4097])
def test_places_are_counted(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert filter_audit.place_counts(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]


def test_failures_in_stretches(monkeypatch):
    texts = ["Aa b", "", "é" * 40, "x # y", "LOUD " * 120, "w%d " % 3 * 150]
    monkeypatch.setattr(filter_audit, "_STRETCH", 20)
    want = [sum(1 << k for k, f in enumerate("ABCD") if fails(t)[f]) for t in texts]
    assert filter_audit.failures(pa.array(texts)).tolist() == want
    assert filter_audit.failures(pa.array(["skip", *texts]).slice(1)).tolist() == want


def test_query_equals_its_sql_on_a_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(queries.filter_interaction(spark, sf), connect(sf), queries.ORACLES["op11_filter_interaction"]) is None
