"""Order-preserving packing of documents into token windows by dynamic programming.

The ids of the documents of a partition follow each other as they stand there. Windows of at most
``size`` ids are cut from that row, so documents keep their order. A window may end where a document
or a sentence ends, or, at a price, on a grid inside a long sentence. With ``f(j)`` the least cost of
everything before the border ``j``::

    f(j) = price(j) + min over i, pos(j) - pos(i) <= size, of f(i) + padding(pos(j) - pos(i))

Padding is ``size`` less the length, so the minimum over the sliding range of ``i`` is that of
``f(i) + pos(i)``, kept in a monotone queue; lengths that are a power of two are not padded and are
further transitions. The row is worked off in blocks; the last window of a block goes into the next.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quitanda.llm.common import arrow_bytes
from quitanda.llm.units import Store, UnitEncoder

SIZE = 2048
END_ID = 1
BLOCK_IDS = 2_000_000  # of a partition, packed together
SENTENCE = 4.0  # price, in padded ids, of a window that ends with a sentence inside a document
INSIDE = 24.0  # and of one that ends inside a sentence
GRID = 64  # ids between the borders inside a long sentence
SHORT = 2.0  # price of a window shorter than ``size``, so that few are made


# --- ids of a text --------------------------------------------------------------------------------

_SPECIAL = re.compile(rb"<\||\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WORD_START = re.compile(rb"(?<=[A-Za-z.,]) (?=[A-Za-z])")
_BLANK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 34, 44, 46, 58, 59, 63]] = True  # ! " , . : ; ?


def text_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of parts of texts that a byte-level tokenizer never joins.

    Parts begin with a text, with white space after something else, with a blank before something else,
    after a lone line end, and with a mark after a letter. Texts with other than ASCII white space are
    no matter of this rule.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    blank = _BLANK[data]
    before = np.r_[True, blank[:-1]]  # white space, or the begin, comes before
    after = np.r_[blank[1:], True]
    begin = blank & ~before
    begin |= (data == 32) & ~after
    lone = np.r_[False, (blank & ~np.r_[True, blank[:-1]])[:-1]] | np.r_[False, edge[:-2]]  # what is before has nothing blank before it
    begin |= ~blank & before & lone & np.r_[False, data[:-1] != 32]
    begin[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    begin |= edge[:-1]
    first = np.flatnonzero(begin)
    return first, np.r_[first[1:], n]


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes without one follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextEncoder(UnitEncoder):
    """Ids of a byte-level tokenizer, each distinct part of text encoded once."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        back = _byte_of_char()
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [bytes(back.get(c, 63) for c in tokenizer.id_to_token(i) or "") for i in range(size)]
        self.length = np.array(list(map(len, tokens)), np.int64)
        self.opens = np.array([t[:1] in (b" ", b"\n", b"\r", b"\t") for t in tokens])
        self.breaks = np.array([b"\n" in t for t in tokens])
        self.ends = np.array([t.rstrip(b"\"')").endswith((b".", b"!", b"?")) for t in tokens])
        super().__init__(Store(self._learn), text_spans, self._whole, _SPECIAL, _WORD_START, lower=False)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Parts without white space but a leading blank are encoded many at a time: each begins where the
        tokenizer begins anew, and the bytes of its ids add up to its own."""
        ids: list = [None] * len(parts)
        spaced, plain, rest = [], [], []
        for n, p in enumerate(parts):
            inner = p[1:] if p[:1] == b" " else p
            if not inner or len(inner.split()) != 1 or inner[:1].isspace() or inner[-1:].isspace():
                rest.append(n)
            else:
                (spaced if p[:1] == b" " else plain).append(n)
        for group, glue in ((spaced, b""), (plain, b"\n")):
            for lo in range(0, len(group), 100):
                some = group[lo:lo + 100]
                sizes = [len(parts[n]) for n in some]
                got = np.array(self._whole(b"".join(glue + parts[n] for n in some).decode()), np.uint32)
                end = np.cumsum(self.length[got])
                stops = np.cumsum(np.array(sizes) + len(glue))
                cut = np.searchsorted(end, stops) + 1
                if end[-1] != stops[-1] or (end[cut - 1] != stops).any():
                    rest += some
                    continue
                a = 0
                for n, b in zip(some, cut.tolist()):
                    ids[n] = got[a + len(glue):b]
                    a = b
        for n in rest:
            ids[n] = np.array(self._whole(parts[n].decode()), np.uint32)
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the ids before which a sentence or line has ended."""
        if len(ids) < 2:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.breaks[ids[:-1]] | (self.ends[ids[:-1]] & self.opens[ids[1:]])) + 1


_loaded: dict[str, TextEncoder] = {}


def encoder_of(path: str) -> TextEncoder:
    """The encoder of this Python worker; what it has learnt outlives one task."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = TextEncoder(Tokenizer.from_file(path))
    return _loaded[path]


# --- cutting windows ------------------------------------------------------------------------------

def borders(ends: np.ndarray, sentences: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """(position, price) of all places where a window may end, from document and sentence ends.

    Position 0 comes first. Gaps above two steps of the grid get borders on it.
    """
    at = np.unique(np.r_[0, ends, sentences])
    gap = np.diff(at)
    extra = np.where(gap > 2 * grid, (gap - 1) // grid, 0)
    begin = np.repeat(at[:-1], extra)
    step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    where = np.r_[at, begin + step * grid]
    price = np.r_[np.where(np.isin(at, ends), 0.0, SENTENCE), np.full(len(begin), INSIDE)]
    order = np.argsort(where, kind="stable")
    return where[order], price[order]


def window_cost(length: int, size: int = SIZE) -> float:
    """Padding of a window, and the price of a short one."""
    if length == size:
        return 0.0
    return SHORT + (0 if length & (length - 1) == 0 else size - length)


def best_cuts(where: np.ndarray, price: np.ndarray, size: int = SIZE) -> list[int]:
    """Ends of the windows of least cost, as numbers of borders; the last border is the last end.

    Of equal costs the longer window, then the padded one, counts.
    """
    n = len(where)
    # the pairs (i, j) a power of two apart, by j
    near_j, near_i = [], []
    step = 1
    while step <= size:
        i = np.searchsorted(where, where - step)
        j = np.flatnonzero((where >= step) & (where[np.minimum(i, n - 1)] == where - step))
        near_j.append(j)
        near_i.append(i[j])
        step *= 2
    near_j, near_i = np.concatenate(near_j), np.concatenate(near_i)
    order = np.argsort(near_j, kind="stable")
    near_j, near_i = near_j[order].tolist() + [n], near_i[order].tolist()
    pos, cost = where.tolist(), price.tolist()
    best, back = [0.0] * n, [0] * n
    queue, level = deque([0]), [0.0] * n
    at = 0
    while near_j[at] == 0:
        at += 1
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        length = p - pos[i]
        least = best[i] + (0.0 if length == size else SHORT + size - length)
        while near_j[at] == j:
            k = near_i[at]
            c = best[k] + (0.0 if p - pos[k] == size else SHORT)
            if c < least:
                least, i = c, k
            at += 1
        best[j], back[j] = least + cost[j], i
        v = level[j] = best[j] + p
        while queue and level[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Takes documents one batch after the other and gives the pieces of finished windows."""

    def __init__(self, part: int, ends_of, size: int, block: int):
        self.part, self.ends_of, self.size, self.block = part, ends_of, size, block
        self.windows = 0
        self.docs, self.done, self.total, self.parts, self.held = [], [], [], [], 0

    def put(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray):
        self.docs += doc_ids
        self.done += [0] * len(doc_ids)
        self.total += counts.tolist()
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.cut(False)

    def cut(self, last: bool):
        """Pieces of all windows, or of all but the one at the end, which waits for more."""
        if not self.held:
            return
        ids = np.concatenate(self.parts)
        done, total = np.array(self.done, np.int64), np.array(self.total, np.int64)
        ends = np.cumsum(total - done)
        where, price = borders(ends, self.ends_of(ids), max(1, min(GRID, self.size // 2)))
        cuts = where[best_cuts(where, price, self.size)]
        if not last:
            cuts = cuts[:-1]
        upto = int(cuts[-1]) if len(cuts) else 0
        if upto:
            edge = np.unique(np.r_[ends[ends <= upto], cuts])
            begin = np.r_[0, edge[:-1]]
            doc, window = np.searchsorted(ends, begin, "right"), np.searchsorted(cuts, begin, "right")
            first, left = ends[doc] - total[doc], np.r_[0, cuts][window]
            for lo in range(0, len(edge), 4000):
                s = slice(lo, lo + 4000)
                flat = np.ascontiguousarray(ids[begin[s][0]:edge[s][-1]], "<u4")
                offsets = (np.r_[begin[s], edge[s][-1]] - begin[s][0]).astype(np.int32) * 4
                yield pa.RecordBatch.from_arrays([
                    pa.array([self.docs[d] for d in doc[s].tolist()], pa.int64()), pa.array(begin[s] - first[s]),
                    pa.array(edge[s] - begin[s]), pa.BinaryArray.from_buffers(pa.binary(), len(begin[s]), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]),
                    pa.array(total[doc[s]]), pa.array(window[s] + self.windows + (self.part << 32)), pa.array(begin[s] - left[s])],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            self.windows += len(cuts)
        whole = int(np.searchsorted(ends, upto, "right"))  # documents wholly given out
        rest = self.docs[whole:]
        done = done[whole:].copy()
        if len(done):
            done[0] = total[whole] - (ends[whole] - upto)
        self.docs, self.done, self.total = rest, done.tolist(), total[whole:].tolist()
        self.parts, self.held = [ids[upto:]], len(ids) - upto


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
         end_id: int = END_ID, block: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece of a document.

    ``ids`` holds the piece's ids as unsigned 32-bit little-endian integers, ``start`` counts the ids of
    the document before it, ``offset`` those of its sequence; ``doc_tokens`` is the document's length with
    the closing ``end_id``. Documents follow as they lie in their partition; nothing is shuffled, and a
    sequence belongs to one partition. Null and empty texts are the end id alone. Very long texts and
    sentences are cut like any other. Repeated rows are packed each, null ids stay null, other columns are
    ignored; among cuts of equal cost the rule of ``best_cuts`` decides; an empty table gives no rows.
    """
    if size & (size - 1):
        raise ValueError("the size must be a power of two")

    def run(batches):
        encoder = encoder_of(tokenizer)
        packer = Packer(TaskContext.get().partitionId(), encoder.sentence_ends, size, block)
        for batch in batches:
            texts = [t or b"" for t in arrow_bytes(batch.column(1))]
            keys, lo = batch.column(0).to_pylist(), 0
            upto = np.cumsum([0, *map(len, texts)])
            while lo < len(texts):
                hi = max(lo + 1, bisect_left(upto, upto[lo] + 4_000_000) - 1)
                counts, got = encoder.encode(texts[lo:hi])
                ids = np.full(len(got) + hi - lo, end_id, np.uint32)
                rest = np.ones(len(ids), bool)
                rest[np.cumsum(counts + 1) - 1] = False
                ids[rest] = got
                yield from packer.put(keys[lo:hi], counts + 1, ids)
                lo = hi
        yield from packer.cut(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
