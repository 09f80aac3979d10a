"""N-gram join, line spread and decontamination against brute force on small fixtures."""

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest

from quitanda.llm import line_spread, ngram_join, pigeonhole
from quitanda.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def grams(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_components(rows):
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[root(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        known = [d for d in ids[root(i)] if d is not None]
        out.append((doc, len(sets[i]), (min(known) if known else None) if sets[i] else doc))
    return out


def corpus(seed, docs=150):
    rng = random.Random(seed)
    common = " ".join(rng.choices(WORDS, k=60))
    texts = []
    for _ in range(docs):
        kind = rng.random()
        if texts and kind < 0.25:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.65:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words[rng.randint(0, 3):]))
        elif kind < 0.75:
            texts.append(common + " " + " ".join(rng.choices(WORDS, k=rng.randint(0, 12))))
        else:
            texts.append(" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 4, 5, 6, 30, 90]))))
    ids = list(range(docs))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def tidy(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, rows, seed):
    data = corpus(seed)
    got = ngram_join.ngram_jaccard(rows(data, "doc_id long, text string"))
    assert tidy(map(tuple, got.collect())) == tidy(brute_components(data))


@pytest.mark.parametrize("block", [512, 3])
def test_links_between_sets_equal_brute_force(spark, rows, block):
    data = corpus(7, 120) + [(500, None), (501, ""), (None, "one two"), (502, "one two")]
    pairs, members = ngram_join.links(rows([(*d, 1) for d in data], "doc_id long, text string, node long"), block=block)
    texts, sets = dict(data), defaultdict(set)
    for r in members.collect():
        sets[r["node"]].add(grams(texts[r["doc_id"]]))
        assert r["n"] == len(grams(texts[r["doc_id"]]))
    assert all(len(s) == 1 for s in sets.values()) and len(sets) == len({grams(t) for _, t in data} - {frozenset()})
    of = {n: next(iter(s)) for n, s in sets.items()}
    want = set()
    for (a, x), (b, y) in combinations(sorted(of.items()), 2):
        both = len(x & y)
        if 100 * both >= 80 * (len(x) + len(y) - both):
            want.add((a, b))
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_edge_rows(spark, rows):
    long = " ".join(f"x{i}" for i in range(30_000))
    data = [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (3, "one TWO"), (9, long), (2, long + " end"),
            (None, "one two"), (4, "a b c d e"), (4, "a b c d e"), (4, "other words stand in here now"), (1, "É é"), (0, "é é")]
    extra = [(i, t, i, t) for i, t in data]
    got = ngram_join.ngram_jaccard(rows(extra, "doc_id long, text string, node long, n string"))
    assert tidy(map(tuple, got.collect())) == tidy(brute_components(data))
    assert ngram_join.ngram_jaccard(rows([], "doc_id long, text string")).collect() == []


def test_near_copies_of_a_hot_text_make_one_component(spark, rows):
    rng = random.Random(5)
    base = rng.choices(WORDS, k=120)
    data = [(0, " ".join(base))]
    for i in range(1, 200):
        words = list(base)
        words[rng.randrange(120)] = f"new{i}"
        data.append((i, " ".join(words)))
    got = ngram_join.ngram_jaccard(rows(data, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_keep_one_keeps_the_smallest_and_all_columns(spark, rows):
    data = [(4, "a b c d e f", "s"), (2, "a b c d e f", None), (7, "", "s"), (8, None, "s"), (9, "q r s t u", "s")]
    got = ngram_join.keep_one(rows(data, "doc_id long, text string, source string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 7, 8, 9]
    assert got.columns == ["doc_id", "text", "source"]


def test_keep_one_decides_by_row(spark, rows):
    copy, clean, other = "a b c d e f g", "q r s t u v w", "one two three four five six"
    data = [(3, copy), (7, copy), (7, clean), (9, other), (9, other), (9, other), (None, other), (5, ""), (5, ""), (None, "solo text")]
    data += [(None, "no id but twice or more")] * 3 + [(None, "no ID but twice or more"), (None, None)]
    got = ngram_join.keep_one(rows([(*d, 1, 2) for d in data], "doc_id long, text string, comp long, sum int"))
    want = [(3, copy), (7, clean), (9, other), (5, ""), (5, ""), (None, "solo text"), (None, None)]
    found = tidy((r["doc_id"], r["text"]) for r in got.collect())
    lone = [r for r in found if r[1] and r[1].lower() == "no id but twice or more"]
    assert len(lone) == 1 and tidy(r for r in found if r not in lone) == tidy(want)
    assert got.columns == ["doc_id", "text", "comp", "sum"]
    assert ngram_join.keep_one(rows([], "doc_id long, text string")).collect() == []


def test_rows_without_ids_link_documents(spark, rows):
    words = [f"w{i}" for i in range(40)]
    data = [(4, " ".join(words)), (None, " ".join(words[2:])), (9, " ".join(words[4:])), (12, " ".join(words[6:]))]
    got = ngram_join.ngram_jaccard(rows(data, "doc_id long, text string"))
    assert tidy(map(tuple, got.collect())) == tidy(brute_components(data))


def test_components_of_a_chain(spark, rows):
    got = components(rows([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long"))
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert {r["node"]: r["comp"] for r in got.collect()} == want


def lines_brute(data, min_sites):
    sites = defaultdict(set)
    for _, text, source in data:
        for line in (text or "").split("\n"):
            line = line.strip(" \t\r\x0b\f")
            if line and source is not None:
                sites[line].add(source)
    out = []
    for doc, text, source in data:
        if text is None:
            out.append((doc, None))
            continue
        kept = "\n".join(x for x in text.split("\n") if len(sites[x.strip(" \t\r\x0b\f")]) < min_sites)
        out.append((doc, kept if kept.strip(" \t\r\x0b\f\n") else text))
    return out


@pytest.mark.parametrize("sites", [3, 9, 10, 11, 14, 15, 16, 40])
def test_lines_go_from_the_threshold_on(spark, rows, sites):
    body = "\n".join(f"own line number {{0}} {i}" for i in range(5))
    data = [(i, " Shared line \n" + body.format(i), f"s{i % sites}") for i in range(sites * 2)]
    got = line_spread.drop_boilerplate(rows(data, "doc_id long, text string, source string"))
    assert tidy((r["doc_id"], r["text"]) for r in got.collect()) == tidy(lines_brute(data, 10))


def test_lines_go_even_where_they_are_most_of_the_text(spark, rows):
    shared = "a long line that stands on every one of the sites"
    data = [(i, f"{shared}\nown {i}", f"s{i}") for i in range(12)]
    data += [(100, shared, "s1"), (101, f"{shared}\n \n{shared}", "s2"), (102, f"{shared}\n\n.", "s3"), (103, "", "s4"), (104, None, "s5")]
    got = line_spread.drop_boilerplate(rows(data, "doc_id long, text string, source string"))
    want = [(i, f"own {i}") for i in range(12)] + [*((i, t) for i, t, _ in data[12:14]), (102, "\n."), (103, ""), (104, None)]
    assert tidy((r["doc_id"], r["text"]) for r in got.collect()) == tidy(want)


def test_line_edges(spark, rows):
    shared = "shared line"
    data = [(i, f"{shared}\nown {i} and much more text here", f"s{i}") for i in range(20)]
    data += [(100, shared, "s1"), (101, None, "s1"), (102, "", "s1"), (103, f"{shared}\n\n\nkeeps its blank lines here", None),
             (None, f"{shared}\nno id, but it goes here too", "s2"), (5, f"{shared}\nsecond row of id five stays", "s5"),
             (104, "\n".join(f"long line {i}" for i in range(20_000)) + "\n" + shared, "s3")]
    df = rows([(*d, "x", [1]) for d in data], "doc_id long, text string, source string, line string, lines array<int>")
    got = line_spread.drop_boilerplate(df)
    assert got.columns == df.columns
    assert tidy((r["doc_id"], r["text"]) for r in got.collect()) == tidy(lines_brute(data, 10))
    assert line_spread.drop_boilerplate(df.limit(0)).collect() == []


def distance_inside(item, text):
    """Least edit distance of item to a substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance(spark):
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc ", k=rng.randint(0, 120)))
        if rng.random() < 0.5:
            text = text[:20] + item[:rng.randint(0, len(item))] + text[20:]
        best, end = pigeonhole.best_end(pigeonhole.masks(item), len(item), text)
        assert best == distance_inside(item, text)
        assert best == distance_inside(item, text[:end]) or best == len(item)


def test_decontamination_equals_brute_force(spark, rows):
    rng = random.Random(9)
    letters = "etaoin shrdlu"
    make = lambda n: pigeonhole.normal("".join(rng.choices(letters, k=n)))
    items = [(i, make(rng.randint(20, 120))) for i in range(12)] + [(50, "short"), (51, None), (None, make(40)), (3, make(60))]
    docs = []
    for i in range(80):
        text = make(rng.randint(0, 300))
        if i % 2:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(item))
                item[at:at + 1] = rng.choice([[], [rng.choice("xyz")], [item[at], "q"]])
            text = f"{text}. {''.join(item).upper()}! {make(50)}"
        docs.append((i, text))
    docs += [(90, None), (91, ""), (None, items[0][1]), (7, items[1][1]), (92, "x" * 200_000 + " " + items[2][1])]
    items += [(60, "What is 2 + 2?"), (61, "--"), (62, "is 2")]
    docs += [(93, "so, what is 2+2 then"), (94, "what is 2 + 22"), (95, "this 2"), (96, "what is 2 2"), (97, "short. what is")]
    framed = rows([(*d, 0, "x") for d in docs], "doc_id long, text string, items int, hits string")
    got = pigeonhole.contaminated(framed, rows([(*i, 1) for i in items], "item_id long, text string, id int"))
    want = []
    for doc, text in docs:
        text = pigeonhole.normal(text)
        best = {}
        for item_id, item in items:
            item = pigeonhole.normal(item)
            if item_id is None or not item:
                continue
            if len(item) < pigeonhole.MIN_CHARS:
                edits = 0 if f" {item} " in f" {text} " else len(item)
            elif len(text) > 10_000:
                edits = 0 if item in text else len(item)
            else:
                edits = distance_inside(item, text)
            if edits <= pigeonhole.budget(len(item)):
                best[item_id] = min(edits, best.get(item_id, edits))
        want.append((doc, sorted(best), [best[i] for i in sorted(best)], bool(best)))
    assert tidy(map(tuple, got.collect())) == tidy(want)


def test_blocks_of_items_give_the_same(spark, rows, monkeypatch):
    docs = rows([(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, "nothing"),
                 (3, "one two three four five six seven alpha beta gamma delta")], "doc_id long, text string")
    items = rows([(1, "alpha beta gamma delta"), (2, "one two three four five six")], "item_id long, text string")
    whole = tidy(map(tuple, pigeonhole.contaminated(docs, items).collect()))
    plain = list(pigeonhole.item_blocks(items))
    assert len(plain) == 1 and [r[3] for r in whole] == [True, True, False, True]
    monkeypatch.setattr(pigeonhole, "item_blocks", lambda *a, **k: ([x] for x in plain[0]))
    assert tidy(map(tuple, pigeonhole.contaminated(docs, items).collect())) == whole
    assert [r["doc_id"] for r in pigeonhole.drop_contaminated(docs, items).collect()] == [2]


def test_nothing_to_search(spark, rows):
    none = rows([], "item_id long, text string")
    docs = rows([(1, "text"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in pigeonhole.contaminated(docs, none).orderBy("doc_id").collect()] == [(1, [], [], False), (2, [], [], False)]
    assert pigeonhole.contaminated(docs.limit(0), none).collect() == []
    assert pigeonhole.drop_contaminated(docs, none).count() == 2
