"""Merge-type segmentation with seeded dropout over a SentencePiece vocabulary.

Text becomes symbols, one per character; an agenda holds every adjacent pair whose union is a piece,
best score first, leftmost first among equals. Each candidate taken from the agenda is skipped if a
keyed hash of the seed, the text, the unit's place in it and the candidate's place falls under the
dropout rate, so every occurrence of a word draws its own. The same seed gives the same segmentation
on any machine and any retry. Without dropout it is the vocabulary's own segmentation. Pieces unknown to the vocabulary are written as bytes, so decoding loses nothing.

No piece joins a blank to what stands before it or crosses a line end, so a text is segmented unit by
unit (blanks and the word after them). Of a unit met more than once the form without dropout is kept,
with the candidates that it merges; an occurrence of which none is skipped has that form. All other
occurrences are segmented each on its own, many at a time.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quitanda.llm.common import arrow_bytes, mix, span_hashes
from quitanda.llm.units import Store, stretches

BLANK = "▁"
RATE = 0.1
FORMS = 1_000_000  # units whose form without dropout a worker remembers
ROWS = 500  # of a batch, segmented and handed on together
LONGEST = 64  # characters of a unit that is segmented together with others
_BORDER = re.compile(rb"(?<! ) (?! )|\n")
_MASK = (1 << 64) - 1
_PLACE, _SIZE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9


def _skipped(key, place, size, limit: int):
    """Whether the candidate at ``place`` of ``size`` characters is skipped; numbers or arrays, 64 bits wide."""
    h = key ^ (place * _PLACE + size * _SIZE & _MASK)
    h = (h ^ h >> 29) * _MIX & _MASK
    return (h ^ h >> 32) & 0xFFFFFFFF < limit


class Pieces:
    """A merge-type vocabulary read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes = [0] * 256
        self.out: list[bytes] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.out.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.out.append(b"")
            else:
                if "\n" in piece or BLANK in piece.lstrip(BLANK):
                    raise ValueError("a piece crosses the unit boundaries")
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                self.out.append(piece.replace(BLANK, " ").encode())
        self.char = np.full(0x110000, -1, np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != BLANK:
                self.char[ord(piece)] = i
        self.char[32] = self.ids.get(BLANK, -1)
        # rank of pieces as merges, best score first
        order = sorted(self.ids.items(), key=lambda x: (-self.score[x[0]], x[1]))
        self.rank = np.zeros(size, np.int64)
        for n, (_, i) in enumerate(order):
            self.rank[i] = n
        # every way to put a piece together from two, in an open-addressed table
        pairs = {(self.ids[p[:c]], self.ids[p[c:]]): i for p, i in self.ids.items() for c in range(1, len(p))
                 if p[:c] in self.ids and p[c:] in self.ids}
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.union = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        value = np.array(list(pairs.values()), np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]  # of several in one slot the last stays
            placed = self.keys[slot] == key
            self.union[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], slot[~placed] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(_PLACE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair of pieces makes, or -1."""
        key = left << 32 | right
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.union[slot], -1)
        live = np.flatnonzero((there != key) & (there >= 0))
        slot = slot[live]
        while len(live):
            slot = slot + 1 & (1 << self.bits) - 1
            there = self.keys[slot]
            hit = there == key[live]
            out[live[hit]] = self.union[slot[hit]]
            on = ~hit & (there >= 0)
            live, slot = live[on], slot[on]
        return out

    def segment(self, unit: str, key: int, limit: int) -> list[str]:
        """Pieces of one unit of any length by an agenda on a heap."""
        score = self.score
        n = len(unit)
        piece = list(unit)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(unit[i:i + 2])
            if s is not None:
                agenda.append((-s, i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            a, b = piece[i], piece[j] if j < n else ""
            if not a or not b or right[i] != j or len(a) + len(b) != size or (limit and _skipped(key, i, size, limit)):
                continue
            piece[i], piece[j] = a + b, ""
            k = right[j]
            right[i] = k
            if k < n:
                left[k] = i
                s = score.get(piece[i] + piece[k])
                if s is not None:
                    heappush(agenda, (-s, i, k, size + len(piece[k])))
            h = left[i]
            if h >= 0:
                s = score.get(piece[h] + piece[i])
                if s is not None:
                    heappush(agenda, (-s, h, i, size + len(piece[h])))
        return [p for p in piece if p]

    def unit_ids(self, unit: str, key: int, limit: int) -> list[int]:
        """Ids of one unit; characters without a piece, and a literal blank mark, as bytes."""
        ids: list[int] = []
        for n, part in enumerate(unit.split(BLANK)):
            if n:
                ids += [self.bytes[b] for b in BLANK.encode()]
            for p in self.segment(part.replace(" ", BLANK), key + n & _MASK, limit):
                got = self.ids.get(p)
                ids += [got] if got is not None else [self.bytes[b] for b in p.replace(BLANK, " ").encode()]
        return ids

    def plain(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which units are short and made of characters that are pieces."""
        bad = np.r_[0, np.cumsum(self.char[chars] < 0)]
        end = np.cumsum(sizes)
        return (bad[end] == bad[end - sizes]) & (sizes <= LONGEST)

    def many(self, chars: np.ndarray, sizes: np.ndarray, keys: np.ndarray, limit: int, trace: bool = False):
        """(ids per unit, all ids) of plain units; with ``trace`` also the merges per unit and all of them.

        The agendas are worked off in step: in each round every unit takes the best candidate of its own
        that is not skipped, the leftmost of equals, and only the candidates beside a merge are made anew.
        A merge is traced as place * 256 + size.
        """
        symbol = self.char[chars]
        total, m = len(symbol), len(sizes)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(m), sizes)
        place = np.arange(total) - begin[owner]
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        after[begin + sizes - 1], before[begin] = -1, -1
        size, union = np.ones(total, np.int64), np.full(total, -1)
        none = np.int64(1) << 62

        def worth(at: np.ndarray) -> np.ndarray:
            """Rank and place of the candidate that starts at each symbol; ``none`` without one."""
            out = np.full(len(at), none)
            inside = np.flatnonzero(after[at] >= 0)
            left = at[inside]
            made = self.joined(symbol[left], symbol[after[left]])
            ok = made >= 0
            inside, left, made = inside[ok], left[ok], made[ok]
            if limit:
                span = (size[left] + size[after[left]]).astype(np.uint64)
                ok = ~_skipped(keys[owner[left]], place[left].astype(np.uint64), span, limit)
                inside, left, made = inside[ok], left[ok], made[ok]
            union[left] = made
            out[inside] = self.rank[made] << 20 | place[left]
            return out

        value = worth(np.arange(total))
        units, local = np.arange(m), begin.copy()  # units at work and where their values begin
        traced = []
        while len(units):
            best = np.minimum.reduceat(value, local)
            live = np.flatnonzero(best < none)
            if 2 * len(live) < len(units):
                width = sizes[units[live]]
                step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                value = value[np.repeat(local[live], width) + step]
                units, best, local = units[live], best[live], np.cumsum(width) - width
                live = np.arange(len(units))
            if not len(live):
                break
            at = best[live] & (1 << 20) - 1
            here = local[live] - begin[units[live]]  # from a symbol to its value
            hit = begin[units[live]] + at
            gone = after[hit]
            symbol[hit] = union[hit]
            size[hit] += size[gone]
            symbol[gone], value[gone + here] = -1, none
            follows = after[gone]
            after[hit] = follows
            more = follows >= 0
            before[follows[more]] = hit[more]
            if trace:
                traced.append((units[live], at * 256 + size[hit]))
            value[hit + here] = worth(hit)
            back = before[hit]
            more = back >= 0
            value[back[more] + here[more]] = worth(back[more])
        kept = symbol >= 0
        counts = np.add.reduceat(kept, begin) if m else np.zeros(0, np.int64)
        if not trace:
            return counts, symbol[kept]
        who = np.concatenate([u for u, _ in traced]) if traced else np.zeros(0, np.int64)
        what = np.concatenate([w for _, w in traced]) if traced else np.zeros(0, np.int64)
        order = np.argsort(who, kind="stable")
        return counts, symbol[kept], np.bincount(who, minlength=m), what[order]


def unit_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of the units of texts: a line end, or blanks and what follows them in the line."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = (data == 10) | np.r_[True, data[:-1] == 10] | ((data == 32) & np.r_[True, data[:-1] != 32])
    begin[bounds[bounds < len(data)]] = True
    first = np.flatnonzero(begin)
    return first, np.r_[first[1:], len(data)]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    upto = np.cumsum(size)
    return np.repeat(first - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class Segmenter:
    """Texts to ids and back."""

    def __init__(self, path: str, seed: int = 0, rate: float = RATE):
        self.pieces = Pieces(path)
        self.seed, self.limit = seed & _MASK, int(rate * (1 << 32))
        self.forms = Store(limit=FORMS)  # of a unit: its merges, then its ids
        self.merges = np.zeros(1 << 16, np.int64)  # how many of the former
        self.out_size = np.array(list(map(len, self.pieces.out)), np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(self.pieces.out), np.uint8)

    def _chars(self, raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(characters, how many per unit) of some units."""
        some = raw[_ranges(first, end - first)]
        upto = np.r_[0, np.cumsum((some & 0xC0) != 0x80)][np.r_[0, np.cumsum(end - first)]]
        return np.frombuffer(some.tobytes().decode().encode("utf-32-le"), np.uint32), np.diff(upto)

    def _learn(self, raw: np.ndarray, h: np.ndarray, first: np.ndarray, end: np.ndarray):
        """Forms of units without dropout."""
        if self.forms.count > self.forms.limit:
            self.forms.forget()
        chars, sizes = self._chars(raw, first, end)
        plain = self.pieces.plain(chars, sizes)
        chars, sizes, h = chars[np.repeat(plain, sizes)], sizes[plain], h[plain]
        if not len(h):
            return
        counts, ids, n, merges = self.pieces.many(chars, sizes, np.zeros(len(h), np.uint64), 0, trace=True)
        both = np.empty(len(ids) + len(merges), np.uint32)
        start = np.cumsum(counts + n) - counts - n
        both[_ranges(start, n)], both[_ranges(start + n, counts)] = merges, ids
        known = self.forms.count
        self.forms.add(h, both, counts + n)
        if self.forms.count > len(self.merges):
            self.merges = np.concatenate([self.merges, np.zeros(max(len(self.merges), len(h)), np.int64)])
        self.merges[known:self.forms.count] = n

    def _unit_ids(self, raw: bytes, first: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per unit, all ids) of stretches of bytes that are units."""
        data = np.frombuffer(raw, np.uint8)
        h = span_hashes(data, first, end)
        h[h == 0] = 1
        at = self.forms.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, one, times = np.unique(h[missing], return_index=True, return_counts=True)
            new, one = new[times > 1], missing[one[times > 1]]
            known = self.forms.count
            self._learn(data, new, first[one], end[one])
            at = self.forms.find(h) if self.forms.count < known else np.where(at < 0, self.forms.find(h), at)
        free = at >= 0
        if self.limit:
            some = np.flatnonzero(free)
            n = self.merges[at[some]]
            merge = self.forms.flat[_ranges(self.forms.start[at[some]], n)].astype(np.uint64)
            hit = _skipped(np.repeat(keys[some], n), merge >> np.uint64(8), merge & np.uint64(255), self.limit)
            free[some[np.repeat(np.arange(len(some)), n)[hit]]] = False
        counts = np.zeros(len(h), np.int64)
        held = at[free]
        begin = self.forms.start[held] + self.merges[held]
        counts[free] = self.forms.start[held + 1] - begin
        ready = self.forms.flat[_ranges(begin, counts[free])]
        drawn = np.flatnonzero(~free)
        chars, sizes = self._chars(data, first[drawn], end[drawn])
        plain = self.pieces.plain(chars, sizes)
        fast, slow = drawn[plain], drawn[~plain]
        counts[fast], ids = self.pieces.many(chars[np.repeat(plain, sizes)], sizes[plain], keys[fast], self.limit)
        odd = [self.pieces.unit_ids(raw[a:b].decode(), k, self.limit)
               for a, b, k in zip(first[slow].tolist(), end[slow].tolist(), keys[slow].tolist())]
        counts[slow] = list(map(len, odd))
        start = np.cumsum(counts) - counts
        flat = np.empty(counts.sum(), np.uint32)
        flat[_ranges(start[free], counts[free])] = ready
        flat[_ranges(start[fast], counts[fast])] = ids
        flat[_ranges(start[slow], counts[slow])] = [i for ids in odd for i in ids]
        return counts, flat

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids).

        The key of a unit is made of the seed, the whole text and the unit's place in it.
        """
        own = np.fromiter((xxhash.xxh3_64_intdigest(t, seed=self.seed) for t in texts), np.uint64, len(texts))
        counts, units, parts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
        for who, held in stretches([b" " + t if t else t for t in texts], _BORDER):  # the blank every text starts with
            raw, bounds = b"".join(held), np.cumsum([0, *map(len, held)])
            first, end = unit_spans(np.frombuffer(raw, np.uint8), bounds)
            upto = np.searchsorted(first, bounds)
            n = np.diff(upto)
            place = np.arange(len(first)) - np.repeat(upto[:-1], n) + np.repeat(units[who], n)
            keys = mix(np.repeat(own[who], n) + place.astype(np.uint64) * np.uint64(_PLACE))
            size, ids = self._unit_ids(raw, first, end, keys)
            counts[who] += np.diff(np.r_[0, np.cumsum(size)][upto])  # a text stands once in a stretch
            units[who] += n
            parts.append(ids)
        return counts, np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text.encode()])[1]

    def decode_many(self, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The text of each list of ids."""
        size = self.out_size[ids]
        raw = self.out_bytes[_ranges(self.out_start[ids], size)].tobytes()
        cut = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]].tolist()
        return [raw[a + 1 if raw[a:a + 1] == b" " and a < b else a:b] for a, b in zip(cut, cut[1:])]

    def decode(self, ids) -> str:
        return self.decode_many(np.array([len(ids)]), np.asarray(ids, np.int64))[0].decode()


_loaded: dict[tuple, Segmenter] = {}


def segmenter(path: str, seed: int = 0, rate: float = RATE) -> Segmenter:
    """The segmenter of this Python worker for these settings; what it remembers outlives one task."""
    key = (path, seed, rate)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Segmenter(path, seed, rate)
    return _loaded[key]


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encoded(docs: DataFrame, model: str, seed: int, rate: float, id_col: str, text_col: str, check: bool) -> DataFrame:
    def run(batches):
        tool = segmenter(model, seed, rate)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):  # handed on in small parts: ids take more room than text
                part = batch.slice(lo, ROWS)
                texts = [t or b"" for t in arrow_bytes(part.column(1))]
                counts, ids = tool.encode_many(texts)
                cols = [part.column(0), _lists(counts, ids)]
                if check:
                    cols.append(pa.array([a == b for a, b in zip(texts, tool.decode_many(counts, ids))], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "lossless"][:len(cols)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>" + ", lossless boolean" * check)


def encode(docs: DataFrame, model: str, seed: int = 0, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row.

    Null and empty texts have no ids; decoding gives the empty text. Very long texts and words are
    segmented whole. Repeated rows get equal ids; null ids stay null; other columns are ignored; an
    empty table gives an empty result.
    """
    return _encoded(docs, model, seed, rate, id_col, text_col, False)


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """``tokens`` with ``decoded``, the text its ``ids`` stand for; other columns are kept."""
    at = tokens.columns.index("ids")

    def run(batches):
        tool = segmenter(model, 0, 0.0)
        for batch in batches:
            lists = batch.column(at)
            texts = tool.decode_many(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode() for t in texts], pa.string())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("decoded", StringType())]))


def checked(docs: DataFrame, model: str, seed: int = 0, rate: float = RATE, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, ids, lossless): the ids, and whether decoding them gave the text back; rows as ``encode`` has them."""
    return _encoded(docs, model, seed, rate, id_col, text_col, True)
