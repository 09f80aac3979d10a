"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may occur in a document with up to ``k`` edits. Cut it into ``k + 1``
pieces: at least one of them is then unharmed. All pieces of all items are searched in one pass over
the text (Aho-Corasick); around every exact piece hit the whole item is matched with Myers'
bit-parallel edit distance. Items are compared in normal form: lower case, letters and digits, single
spaces. Short items, which would match inside words by chance, must stand between word bounds and allow
no edits.
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERRORS = 0.05  # edits allowed per character of an item
BLOCK_CHARS = 4_000_000  # of items searched in one pass over the documents
MIN_CHARS = 16

_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(length: int, errors: float = ERRORS) -> int:
    return int(length * errors)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors + 1`` nearly equal pieces."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return out


def best_end(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(smallest edit distance of the item to a substring of ``text``, its end), by Myers' recurrence."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may start anywhere
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Searches a set of (item id, normal text) in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        self.items = [(i, t, budget(len(t), errors), masks(t)) for i, t in items]
        where = defaultdict(list)
        for n, (_, t, k, _) in enumerate(self.items):
            for at, piece in pieces(t, k) if len(t) >= MIN_CHARS else [(None, t)]:
                where[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(item id, edits) of every item that the normal text holds, by item id."""
        if self.empty or not text:
            return []
        spots = defaultdict(set)  # item -> starts it could have, on a grid of its error budget
        found: dict[int, int] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                if at is None:  # a short item
                    if text[end - size:end - size + 1] in ("", " ") and text[end + 1:end + 2] in ("", " "):
                        found[self.items[n][0]] = 0
                    continue
                k = self.items[n][2]
                spots[n].add((end + 1 - size - at) // (k + 1))
        for n, cells in spots.items():
            item_id, item, k, peq = self.items[n]
            m, step = len(item), k + 1
            reach = -1
            for cell in sorted(cells):
                lo, hi = cell * step - k, (cell + 1) * step + m + k
                if hi <= reach:
                    continue
                reach = hi
                edits, _ = best_end(peq, m, text[max(0, lo):max(0, hi)])
                if edits <= k:
                    found[item_id] = min(edits, found.get(item_id, edits))
                    if not found[item_id]:
                        break
        return sorted(found.items())


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """Blocks of (item id, normal text), each of bounded size, read one after the other."""
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).dropna().distinct()
    for r in rows.orderBy("id", "t").toLocalIterator():
        text = normal(r["t"])
        if not text:
            continue
        block.append((r["id"], text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", errors: float = ERRORS) -> DataFrame:
    """(doc_id, items, edits, contaminated) for every row of ``docs``.

    ``items`` has the ids of the test items that occur in the text with at most ``errors`` edits per
    character, sorted, and ``edits`` the edits of each. Whole texts are searched, however long. Null
    and empty texts hold none. Items under MIN_CHARS characters in normal form are found as whole words
    without edits; those with a null id or text, or without a letter or digit, are not searched. Items
    with equal texts are all reported; of repeated item ids the best match counts. Repeated documents and null ids each give a row; other columns are ignored; without
    items, or without documents, nothing is contaminated.
    """
    parts = [_search(docs, block, id_col, text_col, errors) for block in item_blocks(items, item_id, item_text)]
    found = parts[0] if parts else _search(docs, [], id_col, text_col, errors)
    for part in parts[1:]:
        found = found.unionAll(part)
    if len(parts) > 1:  # the same rows were searched once per block; a row's number in its text group tells rows apart
        found = (found.groupBy("doc_id", "sum", "block").agg(F.count("*").alias("rows"), F.first("hits").alias("hits"))
                 .groupBy("doc_id", "sum").agg(F.max("rows").alias("rows"), F.flatten(F.collect_list("hits")).alias("hits"))
                 .select("doc_id", F.sort_array("hits").alias("hits"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))))
    return found.select("doc_id", F.transform("hits", lambda h: h["item"]).alias("items"),
                        F.transform("hits", lambda h: h["edits"]).alias("edits"), (F.size("hits") > 0).alias("contaminated"))


def _search(docs: DataFrame, block: list[tuple[int, str]], id_col: str, text_col: str, errors: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_CHARS characters
    number = block[0][0] if block else 0
    kind = pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int64())]))

    def run(batches):
        matcher = Matcher(shared.value, errors)
        for batch in batches:
            hits = [[{"item": i, "edits": e} for i, e in matcher.hits(normal(t))] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([number] * len(hits), pa.int64()), pa.array(hits, kind)],
                ["doc_id", "sum", "block", "hits"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("sum")).mapInArrow(
        run, "doc_id long, sum long, block long, hits array<struct<item bigint, edits bigint>>")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      errors: float = ERRORS) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; all columns kept; texts do not move."""
    out, at = docs, docs.columns.index(text_col)
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, errors)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.hits(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
