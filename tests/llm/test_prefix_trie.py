"""Prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quitanda.llm import prefix_trie, queries
from tests.oracle import connect, difference

DDL = "conv_id long, turn long, role string, text string"


def rebuilt(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(data):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt(data).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(convs) - 1) * words
    return sorted((min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), kids[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, convs in members.items())


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def talk(seed, convs):
    rng = random.Random(seed)
    data = []
    for c in rng.sample(range(3 * convs), convs):
        depth = rng.choice([1, 1, 2, 3, 5, 9])
        say = lambda d: rng.choice(["yes", "no thanks", "what is\tit"]) if rng.random() < 0.9 else f"turn {d} of {c}"  # noqa: E731, B023
        data += [(c, rng.choice([d, 10 * d]), rng.choice(["user", "user", "bot", None]), say(d)) for d in range(depth)]
    data = [(c, d if i else None, r, t) for i, (c, d, r, t) in enumerate(data)]
    seen, out = set(), []
    for row in data:  # ties are ordered by a hash, so none here
        if row[:2] not in seen:
            seen.add(row[:2])
            out.append(row)
    return out


@pytest.mark.parametrize("seed, convs, limit", [(1, 150, 200_000), (2, 150, 20), (3, 400, 1), (4, 12, 5)])
def test_nodes_equal_brute_force(spark, rows, seed, convs, limit):
    data = talk(seed, convs)
    assert got(prefix_trie.prefix_trie(rows(data, DDL), shard_turns=limit)) == brute(data)


def test_edge_conversations(spark, rows):
    data = [(1, 0, "user", "only turn"), (21, 5, None, None), (-7, 0, "user", "negative"), (-20, 0, "user", ""), (None, 0, "user", "nobody"),
            (40, None, "a", "b c"), (40, 1, "ab", " c"), (41, 1, "a", "b c"), (41, 2, "x", "long " * 50_000), (43, 1, "a", "bc"), (2**40, 0, "user", "é 日本")]
    data += [(60, i, "user", f"turn {i}") for i in range(150)] + [(61, i, "user", f"turn {i}") for i in range(120)]
    data += [(c, i, "user", ["same", "words again"][i % 2]) for c in range(200, 260) for i in range(6)]
    for limit in (200_000, 50):
        frame = rows([(*d, 1, "x") for d in data], DDL + ", n int, key string").repartition(5)
        assert got(prefix_trie.prefix_trie(frame, shard_turns=limit)) == brute(data)
    assert prefix_trie.prefix_trie(rows([], DDL)).collect() == []


def test_ties_are_ordered_alike(spark, rows):
    data = [(c, 0, role, "x") for c in (8, 28, 48) for role in ("user", "bot", "user")]
    one, two = (got(prefix_trie.prefix_trie(rows(x, DDL))) for x in (data, data[::-1]))
    assert one == two and one[0][3] == 3


def test_parentheses_close():
    rng = random.Random(6)
    for n in (1, 2, 40, 700, 5000):
        step, depth = [1], 1
        while depth:
            up = rng.random() < (0.9 if len(step) < n else 0.02)
            step.append(1 if up else -1)
            depth += step[-1]
        stack, want = [], {}
        for i, s in enumerate(step):
            if s > 0:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opened = np.array(sorted(want))
        assert prefix_trie.find_close(np.cumsum(step), opened).tolist() == [want[i] for i in opened.tolist()]


def test_range_minima():
    values = np.random.default_rng(0).integers(0, 1000, 300)
    first = np.random.default_rng(1).integers(0, 299, 500)
    end = first + 1 + np.random.default_rng(2).integers(0, 300, 500) % (300 - first)
    assert prefix_trie.range_min(values, first, end).tolist() == [values[a:b].min() for a, b in zip(first, end)]


def test_query_equals_its_sql_on_a_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(queries.conversation_trie(spark, sf), connect(sf), queries.ORACLES["op13_conversation_trie"]) is None
