"""How filters interact: survivors of every subset of five filters, from truth-table words.

Each document becomes a 32-bit word: bit ``S`` says whether it passes all filters of the subset ``S``.
Adding up the bits of a column of words, place by place, gives the survivors of every subset at once.
Words are added by carry-save adders: three words become a sum and a carry of double weight, so the
work per word is a few logical operations for all 32 places. Everything asked about any order of the
filters follows from the subset survivors of a part and of its labelled documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quitanda.llm.common import distinct, word_hashes
from quitanda.session import materialize

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
MIN_WORDS = 100
MIN_DISTINCT = 80  # per cent of the words
MAX_CAPITALS = 10  # per cent of the code points
SYMBOLS = "#$%&*|"
ALL, GOOD, TOXIC = range(3)
HELD = 1 << 20  # words of a task that are added up together

SURVIVAL = np.array([sum(1 << s for s in range(EVERY + 1) if not fails & s) for fails in range(EVERY + 1)], np.uint32)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_STRETCH = 1 << 20


def _texts(column: pa.Array):
    """(bytes of some texts in a row, where each begins and ends)."""
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _STRETCH, "right")) - 1)
        yield data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def failures(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails; no text may be null."""
    if not len(column):
        return np.zeros(0, np.int64)
    words = word_hashes(column, lower=False)
    count = np.array([len(w) for w in words])
    kinds = np.array([len(distinct(w)) for w in words])
    sums = []
    for data, bounds in _texts(column):
        flags = ((data >= 65) & (data <= 90), (data & 0xC0) != 0x80, _SYMBOL[data])
        sums.append([np.diff(np.r_[0, np.cumsum(f)][bounds]) for f in flags])
    capitals, points, symbols = (np.concatenate(x) for x in zip(*sums))
    return ((count < MIN_WORDS) * 1 + (100 * kinds < MIN_DISTINCT * count) * 2
            + (100 * capitals > MAX_CAPITALS * points) * 4 + (symbols > 0) * 8)


def place_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    counts, weight = np.zeros(32, np.int64), 0
    while len(words):
        carries = []
        while len(words) > 2:
            k = len(words) // 3
            a, b, c = words[:k], words[k:2 * k], words[2 * k:3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * k:]])
        for w in words.tolist():
            counts += (w >> np.arange(32) & 1) << weight
        words = np.concatenate(carries) if carries else words[:0]
        weight += 1
    return counts


def survivors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
              label_id: str = "doc_id") -> DataFrame:
    """(part, label, subset, survivors): documents that pass all filters of a subset, per part and label.

    ``label`` is 0 for all documents, 1 for those with quality 1, 2 for the toxic ones; a subset is a
    number with one bit per filter. Part and label classes without documents have no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(failures(b.column(4)).astype(np.int32))],
                                             ["doc_id", "part", "h1", "h2", "fails"])

    seen = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                    F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
        .mapInArrow(measure, "doc_id long, part string, h1 long, h2 long, fails int"), "audit-documents")
    # The first document of each text is joined back by its own id, so a text with many copies is no hot key.
    first = (seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
             .withColumn("first", F.lit(True)))
    marks = (labels.select(F.col(label_id).cast("long").alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
                           F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("bad"))
             .filter("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("bad").alias("bad")))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = (seen.join(first, ["doc_id", "h1", "h2"], "left").join(marks, "doc_id", "left")
            .select("part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("fails"),
                    F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad")))

    def add(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            out = []
            for part, blocks in held.items():
                words, good, bad = (np.concatenate(x) for x in zip(*blocks))
                for label, some in ((ALL, words), (GOOD, words[good]), (TOXIC, words[bad])):
                    if len(some):
                        out += [(part, label, s, int(n)) for s, n in enumerate(place_counts(some))]
            held.clear()
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64()))],
                                              ["part", "label", "subset", "survivors"])

        for b in batches:
            parts = b.column(0).dictionary_encode()
            words = SURVIVAL[b.column(1).to_numpy()]
            good, bad = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            which = parts.indices.to_numpy()
            for n, part in enumerate(parts.dictionary.to_pylist()):
                at = which == n
                held.setdefault(part, []).append((words[at], good[at], bad[at]))
            size += b.num_rows
            if size >= HELD:
                yield flush()
                size = 0
        if held:
            yield flush()

    partial = rows.mapInArrow(add, "part string, label int, subset int, survivors long")
    return partial.groupBy("part", "label", "subset").agg(F.sum("survivors").alias("survivors"))


def _report(alive: np.ndarray) -> list[tuple]:
    """The rows of one part, from the survivors of each label and subset."""
    out = []
    lost = lambda label, before, bit: int(alive[label][before] - alive[label][before | bit])
    n = len(FILTERS)
    shapley = []
    for f in range(n):
        others = [s for s in range(EVERY + 1) if not s >> f & 1]
        shapley.append(sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * lost(ALL, s, 1 << f) for s in others))
    for order in permutations(range(n)):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            removed = lost(ALL, before, bit)
            out.append((name, step, int(alive[ALL][before | bit]), removed, lost(ALL, 0, bit) - removed, lost(ALL, EVERY ^ bit, bit),
                        lost(GOOD, before, bit), lost(TOXIC, before, bit), shapley[f]))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          label_id: str = "doc_id") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 100 words; B distinct words under 80 % of the words; C capitals A-Z over 10 % of the
    code points; D any of ``#$%&*|``; E a text that a smaller id of the table has too. Null and empty texts
    and null parts count as empty; so a null text is a copy of an empty one. A null id is neither smaller
    nor larger than others: such a row passes E. Of repeated rows under one id none is smaller: each
    counts, and all pass E if theirs is the smallest id of the text. Several labels of an id count as one
    that has whatever any of them has. Very long texts are measured whole; other columns are ignored; an
    empty table has no parts and gives no rows.
    """
    names = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    tables = survivors(docs, labels, id_col, text_col, part_col, label_id).groupBy("part").agg(
        F.collect_list(F.struct("label", "subset", "survivors")).alias("counts"))  # at most 96 a part

    def expand(batches):
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                alive = np.zeros((3, EVERY + 1), np.int64)
                for c in counts:
                    alive[c["label"], c["subset"]] = c["survivors"]
                cols = list(zip(*_report(alive)))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(cols[0]), pa.string()), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                    ["part", "filter_order", "step", *(x.split()[0] for x in names.split(", "))])

    return tables.mapInArrow(expand, f"part string, filter_order string, step int, {names}")
