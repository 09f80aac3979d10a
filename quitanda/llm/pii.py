"""Personal data: exact patterns, and a character model that adds spans they miss.

``base_spans`` finds the four kinds by pattern and check. ``Tagger`` is a character-level
bidirectional LSTM whose outputs are scored by a linear-chain CRF; it is trained in numpy from the
labelled spans of a bounded sample. Texts are cut into overlapping windows around every character
that personal data cannot be without (a digit or ``@``); elsewhere the answer is "none" by
definition, so nothing is skipped. The scores of overlapping windows are blended, the middle of a
window counting most, and one Viterbi pass over each joined stretch decides all its characters.
"""

from __future__ import annotations

import hashlib
import re
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quitanda.session import materialize

KINDS = ("email", "ip", "card", "phone")

# --- patterns -------------------------------------------------------------------------------------

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, and takes whole runs, so the search is linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        # a failed ``@`` is no local character, so no later match reaches back over it
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the spans the patterns give, by kind and then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _TRIGGER.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 64 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# --- the model ------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
_CLASSES = 128


def _codes(text: str) -> np.ndarray:
    """ASCII characters stand for themselves, all others for one class."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(raw < _CLASSES - 1, raw, _CLASSES - 1).astype(np.int64)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Bidirectional LSTM over characters with CRF transitions."""

    def __init__(self, hidden: int = 16, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.3, (_CLASSES, 4 * hidden))
            self.p[f"x{side}"][:, hidden:2 * hidden] += 1.0  # forget gate opens at first
            self.p[f"h{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        self.p["out"] = rng.normal(0, 0.2, (2 * hidden, TAGS))
        self.p["bias"] = np.zeros(TAGS)
        self.p["move"] = np.zeros((TAGS, TAGS))
        self.allowed = np.zeros((TAGS, TAGS))
        for i in range(2, TAGS, 2):  # inside follows only begin or inside of its own kind
            bad = [j for j in range(TAGS) if j not in (i, i - 1)]
            self.allowed[bad, i] = -1e4

    def _run(self, codes: np.ndarray, side: str):
        batch, length = codes.shape
        n = self.hidden
        x, w = self.p[f"x{side}"][codes], self.p[f"h{side}"]
        h, c = np.zeros((batch, n)), np.zeros((batch, n))
        kept = []
        for t in range(length):
            z = x[:, t] + h @ w
            gate = _sigmoid(z[:, :3 * n])
            i, f, o = gate[:, :n], gate[:, n:2 * n], gate[:, 2 * n:]
            g = np.tanh(z[:, 3 * n:])
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            kept.append((i, f, o, g, before, tc, h_before, h))
        return kept

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(batch, length, tag) scores of windows of equal length."""
        fwd, bwd = self._run(codes, "f"), self._run(codes[:, ::-1], "b")
        h = np.concatenate([np.stack([k[7] for k in fwd], 1), np.stack([k[7] for k in bwd], 1)[:, ::-1]], 2)
        return h @ self.p["out"] + self.p["bias"]

    def _back(self, codes, side, kept, grad, grads):
        n = self.hidden
        w = self.p[f"h{side}"]
        dx, dw = np.zeros_like(self.p[f"x{side}"]), np.zeros_like(w)
        dh, dc = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, before, tc, h_before, _ = kept[t]
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                                 dc * i * (1 - g * g)], 1)
            np.add.at(dx, codes[:, t], dz)
            dw += h_before.T @ dz
            dh, dc = dz @ w.T, dc * f
        grads[f"x{side}"], grads[f"h{side}"] = dx, dw

    def loss_and_grads(self, codes: np.ndarray, tags: np.ndarray):
        """Mean negative log likelihood of the tag sequences and its gradients."""
        batch, length = codes.shape
        fwd, bwd = self._run(codes, "f"), self._run(codes[:, ::-1], "b")
        h = np.concatenate([np.stack([k[7] for k in fwd], 1), np.stack([k[7] for k in bwd], 1)[:, ::-1]], 2)
        e = h @ self.p["out"] + self.p["bias"]
        move = self.p["move"] + self.allowed
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        add = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        for t in range(1, length):
            alpha[:, t] = add(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = add(move + (beta[:, t + 1] + e[:, t + 1])[:, None, :], 2)
        total = add(alpha[:, -1], 1)
        at = np.arange(batch)
        gold = sum(e[at, t, tags[:, t]] for t in range(length))
        gold = gold + sum(move[tags[:, t], tags[:, t + 1]] for t in range(length - 1))
        de = np.exp(alpha + beta - total[:, None, None])
        dmove = np.zeros_like(move)
        for t in range(length - 1):
            both = alpha[:, t, :, None] + move + (beta[:, t + 1] + e[:, t + 1])[:, None, :] - total[:, None, None]
            dmove += np.exp(both).sum(0)
            np.add.at(dmove, (tags[:, t], tags[:, t + 1]), -1.0)
            de[at, t, tags[:, t]] -= 1
        de[at, length - 1, tags[:, -1]] -= 1
        de, dmove = de / batch, dmove / batch
        grads = {"move": dmove, "bias": de.sum((0, 1)), "out": np.einsum("bth,btk->hk", h, de)}
        dh = de @ self.p["out"].T
        self._back(codes, "f", fwd, dh[:, :, :self.hidden], grads)
        self._back(codes[:, ::-1], "b", bwd, dh[:, ::-1, self.hidden:], grads)
        return float((total - gold).mean()), grads

    def train(self, codes: np.ndarray, tags: np.ndarray, steps: int = 250, batch: int = 32, rate: float = 0.02, seed: int = 3):
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), batch)
            _, grads = self.loss_and_grads(codes[pick], tags[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        move = self.p["move"] + self.allowed
        best, back = e[0].copy(), np.zeros(e.shape, np.int64)
        for t in range(1, len(e)):
            step = best[:, None] + move
            back[t] = step.argmax(0)
            best = step.max(0) + e[t]
        path = np.empty(len(e), np.int64)
        path[-1] = best.argmax()
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def stretches(text: str, window: int) -> list[tuple[int, int]]:
    """The parts of a text within half a window of a digit or ``@``."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - window // 2), min(len(text), m.start() + window // 2)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def windows_of(lo: int, hi: int, window: int) -> list[int]:
    """Starts of half-overlapping windows that cover [lo, hi)."""
    return list(range(lo, max(lo + 1, hi - window // 2), window // 2))


def decode(model: Tagger, texts: list[str], window: int = 64, batch: int = 256) -> list[list[tuple[int, int, int]]]:
    """Model spans (kind, start, end) per text."""
    weight = 1.0 + np.minimum(np.arange(window), np.arange(window)[::-1])
    jobs = [(i, lo, hi) for i, text in enumerate(texts) for lo, hi in stretches(text, window)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    codes = {}
    parts = [(j, s) for j, (_, lo, hi) in enumerate(jobs) for s in windows_of(lo, hi, window)]
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def close(upto: int):
        for j in [x for x in sums if x < upto]:
            i, lo, hi = jobs[j]
            total, mass = sums.pop(j)
            path = model.viterbi(total / mass[:, None])
            t = 0
            while t < len(path):
                if path[t] % 2 == 1:
                    end = t + 1
                    while end < len(path) and path[end] == path[t] + 1:
                        end += 1
                    out[i].append(((int(path[t]) - 1) // 2, lo + t, lo + end))
                    t = end
                else:
                    t += 1

    for at in range(0, len(parts), batch):
        chunk = parts[at:at + batch]
        grid = np.full((len(chunk), window), 32, np.int64)
        for r, (j, s) in enumerate(chunk):
            i, lo, hi = jobs[j]
            if i not in codes:
                codes.clear()
                codes[i] = _codes(texts[i])
            part = codes[i][s:min(s + window, hi)]
            grid[r, :len(part)] = part
        scores = model.emissions(grid)
        for r, (j, s) in enumerate(chunk):
            _, lo, hi = jobs[j]
            total, mass = sums.setdefault(j, (np.zeros((hi - lo, TAGS)), np.zeros(hi - lo)))
            n = min(window, hi - s)
            total[s - lo:s - lo + n] += scores[r, :n] * weight[:n, None]
            mass[s - lo:s - lo + n] += weight[:n]
        close(chunk[-1][0])
    close(len(jobs))
    return out


def plausible(kind: int, text: str, start: int, end: int) -> bool:
    """What any span of a kind must have, however it is written; bounds on what the model may add."""
    part = text[start:end]
    digits = len(_NOT_DIGIT.sub("", part))
    if kind == 0:
        return "@" in part and len(part) >= 6
    if kind == 1:
        return 4 <= digits <= 12 and sum(c in ".:" for c in part) >= 3
    if kind == 2:
        return 13 <= digits <= 19
    return 9 <= digits <= 15


def add_spans(base, found, text: str):
    """Base spans stay; a model span joins them if it touches none and is plausible."""
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for kind, a, b in sorted(found, key=lambda s: s[1]):
        if plausible(kind, text, a, b) and all(b <= x or y <= a for x, y in taken):
            added.append((kind, a, b))
            taken.append((a, b))
    return sorted([*base, *added])


# --- training rows --------------------------------------------------------------------------------

def _variants(kind: int, part: str) -> list[str]:
    """The same value as people also write it; these teach the model what the patterns miss."""
    if kind == 0:
        return [part, part.replace("@", " @ ")]
    if kind == 1:
        return [part, part.replace(".", " . ")]
    if kind == 2:
        return [part, ".".join(part[i:i + 4] for i in range(0, len(part), 4))]
    return [part, part.lstrip("+"), "00" + part.lstrip("+")]


def training_windows(samples: list[tuple[str, list[tuple[int, int, int]]]], window: int = 64):
    """Windows with one labelled span each, written in each of its ways, and windows around other triggers."""
    codes, tags = [], []

    def put(before, part, after, kind):
        shift = (len(part) + len(before) * 7) % max(1, window - len(part)) if len(part) < window else 0
        text = (before[-shift:] if shift else "") + part + after
        y = np.zeros(window, np.int64)
        if kind is not None:
            y[shift:shift + len(part)] = 2 + 2 * kind
            y[shift] = 1 + 2 * kind
        x = np.full(window, 32, np.int64)
        c = _codes(text[:window])
        x[:len(c)] = c
        codes.append(x)
        tags.append(y)

    for text, spans in samples:
        for kind, a, b in spans:
            before, after = text[max(0, a - window):a], text[b:b + window]
            if any(x < b + window and a - window < y and (x, y) != (a, b) for _, x, y in spans):
                before, after = "and ", " and"
            for part in _variants(kind, text[a:b]):
                put(before.rjust(window), part, after, kind)
        for m in list(_TRIGGER.finditer(text))[:50]:
            if all(m.start() + window < a or b + window < m.start() for _, a, b in spans):
                put(text[max(0, m.start() - window):m.start()].rjust(window), m[0], text[m.end():m.end() + window], None)
    return np.array(codes).reshape(-1, window), np.array(tags).reshape(-1, window)


def _pieces(text: str, spans: list[tuple[int, int, int]], window: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most 40 pieces of a text around triggers, and one around the first span of each kind they lack."""
    def piece(lo, hi):
        return text[lo:hi], [(k, a - lo, b - lo) for k, a, b in spans if lo <= a and b <= hi]

    out = []
    for lo, hi in stretches(text, 4 * window)[:40]:
        hi = min(hi, lo + 16 * window)
        if not any(a < lo < b or a < hi < b for _, a, b in spans):
            out.append(piece(lo, hi))
    for kind in sorted({k for k, _, _ in spans} - {k for _, own in out for k, _, _ in own}):
        _, first, last = next(s for s in spans if s[0] == kind)
        lo, hi = max(0, first - 2 * window), min(len(text), last + 2 * window)
        lo = max([lo, *(b for _, a, b in spans if a < lo < b <= first)])
        hi = min([hi, *(a for _, a, b in spans if last <= a < hi < b)])
        out.append(piece(lo, hi))
    return out


def training_sample(docs: DataFrame, text_col: str = "text", rows: int = 240, window: int = 64):
    """Pieces, with their spans, of at most ``rows`` distinct texts that have a base span.

    Each kind in turn gives the text with its smallest hash until all are taken, so no kind and no
    group of copies crowds out the others. A task hands on ``rows`` texts a kind at most; the driver
    gets their hashes and the pieces of the chosen.
    """
    def cut(batches):
        best: list[dict] = [{} for _ in KINDS]
        for batch in batches:
            for x in batch.column(0).to_pylist():
                spans = base_spans(x)
                if not spans:
                    continue
                key = xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63)
                kinds = [k for k in {k for k, _, _ in spans} if key not in best[k]]
                if not kinds:
                    continue
                pieces = [{"text": p, "spans": [list(s) for s in own]} for p, own in _pieces(x, spans, window)]
                for k in kinds:
                    best[k][key] = pieces
                    if len(best[k]) > 2 * rows:
                        best[k] = {h: best[k][h] for h in sorted(best[k])[:rows]}
        for k, found in enumerate(best):
            keys = sorted(found)[:rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([k] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array([found[h] for h in keys], pa.list_(pa.struct(
                    [("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])))], ["kind", "hash", "pieces"])

    text = F.col(text_col).cast("string")
    found = materialize(docs.select(text.alias("text")).filter(text.isNotNull()).mapInArrow(
        cut, "kind int, hash long, pieces array<struct<text string, spans array<array<bigint>>>>"), "pii-sample")
    first = [[r["hash"] for r in found.filter(F.col("kind") == k).select("hash").distinct().orderBy("hash").limit(rows).collect()]
             for k in range(len(KINDS))]
    chosen = list(dict.fromkeys(h for turn in zip_longest(*first) for h in turn if h is not None))[:rows]
    got = found.filter(F.col("hash").isin(chosen)).dropDuplicates(["hash"]).orderBy("hash").collect()
    return [(p["text"], [tuple(s) for s in p["spans"]]) for row in got for p in row["pieces"]]


def fit(docs: DataFrame, text_col: str = "text", rows: int = 240, window: int = 64, steps: int = 250) -> Tagger | None:
    """A model from at most ``rows`` distinct texts that have a span, see ``training_sample``; None without any."""
    codes, tags = training_windows(training_sample(docs, text_col, rows, window), window)
    if not (tags > 0).any():
        return None
    return Tagger().train(codes, tags, steps)


def find_pii(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text", window: int = 64) -> DataFrame:
    """(doc_id, base, spans) per row; spans are (kind, start, end) in code points, end exclusive.

    ``base`` has what the patterns give, ``spans`` that and what the model adds; both ordered by kind
    as listed in KINDS, then start. Null and empty texts have none. Repeated rows each give a row,
    null ids stay null, other columns are ignored, an empty table gives an empty result. Long texts
    are searched whole; the patterns take time in proportion to the text.
    """
    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda s: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s]
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            base = [base_spans(x) for x in texts]
            found: list[list] = [[] for _ in texts]
            if model is not None:
                some = [i for i, x in enumerate(texts) if _TRIGGER.search(x)]
                for at in range(0, len(some), 64):
                    part = some[at:at + 64]
                    for i, spans in zip(part, decode(model, [texts[i] for i in part], window)):
                        found[i] = spans
            both = [add_spans(b, f, x) for b, f, x in zip(base, found, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([rows(b) for b in base], kind), pa.array([rows(b) for b in both], kind)],
                ["doc_id", "base", "spans"])

    each = "array<struct<kind string, start bigint, end bigint>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, base {each}, spans {each}")


def listed(spans):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text, spans):
    """The text with each span replaced by its kind in brackets; overlapping spans are one."""
    start = F.array_sort(spans, lambda a, b: (a["start"] - b["start"]).cast("int"))
    merged = F.aggregate(
        start, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], text.substr(acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")),
                         F.lit("["), s["kind"], F.lit("]"))).alias("out"),
            s["end"].alias("at"))))
    return F.concat(merged["out"], F.substr(text, merged["at"].cast("int") + 1))


def base_hash(spans):
    return F.sha2(listed(spans), 256)


def sha256_of(spans) -> str:
    return hashlib.sha256(span_text(spans).encode()).hexdigest()
