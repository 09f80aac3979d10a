"""Toxicity by a classifier chain over linear models.

Categories are predicted one after the other. Each model sees the words of a text and the
probabilities of the categories before it; while training, those are out-of-fold predictions, so a
later model learns from errors as it will meet them. The last category is the label itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quitanda.llm.common import arrow_bytes, list_column
from quitanda.session import materialize

# Seed words of the categories before the label; a labelled text belongs to each whose seeds it has.
CATEGORIES = (
    ("insult", ("idiot", "moron", "loser", "clown")),
    ("contempt", ("stupid", "pathetic", "worthless")),
    ("disgust", ("scum", "trash", "disgusting")),
)
LABEL = "toxic"
NAMES = (*(name for name, _ in CATEGORIES), LABEL)

_PREFIX = 5
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def features(text: bytes | None) -> set[bytes]:
    """Distinct words (letters, A-Z lower-cased) and, marked, the first five bytes of longer words."""
    words = set((text or b"").translate(_LETTERS).split())
    return words | {b"^" + w[:_PREFIX] for w in words if len(w) > _PREFIX}


@dataclass
class Chain:
    """``names``: hashes of the features used; one row of ``weights`` per category: features, earlier
    categories, intercept."""

    names: np.ndarray
    weights: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(row, category) probabilities for a 0/1 feature matrix."""
        out = np.zeros((len(x), len(self.weights)))
        for c, w in enumerate(self.weights):
            out[:, c] = _probability(np.hstack([x, out[:, :c]]), w)
        return out


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the intercept is free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def train_chain(names: np.ndarray, x: np.ndarray, y: np.ndarray, folds: int = 5) -> Chain:
    """A chain over the columns of ``y``; row ``i`` is in fold ``i % folds``."""
    fold = np.arange(len(x)) % folds
    before = np.zeros((len(x), 0))
    weights = []
    for c in range(y.shape[1]):
        full = np.hstack([x, before])
        held = np.zeros(len(x))
        for f in range(folds):
            inside, outside = fold != f, fold == f
            if inside.any() and outside.any():
                held[outside] = _probability(full[outside], _logistic(full[inside], y[inside, c]))
        weights.append(_logistic(full, y[:, c]))
        before = np.hstack([before, held[:, None]])
    return Chain(names, weights)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = LABEL,
        rows: int = 8000, words: int = 512) -> Chain | None:
    """A chain from at most ``rows`` labelled texts (smallest id hashes); None if one class is missing.

    ``words`` features are kept: those whose shares in toxic and other texts differ most for their
    sampling error. Counting them is a Spark job; the driver gets the features kept and, per text,
    which of them it has.
    """
    seeds = [{_hash(s.encode()) for s in group} for _, group in CATEGORIES]
    every = sorted(set().union(*seeds))

    def run(batches):
        for batch in batches:
            sets = [np.array(sorted(map(_hash, features(t))), np.int64) for t in arrow_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), list_column(sets, pa.int64())], ["id", "y", "feats"])

    pick = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("y"))
            .dropna().groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows))
    sample = materialize(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(pick), "id").select("id", "y", "text")
        .mapInArrow(run, "id long, y long, feats array<long>"), "toxicity-sample")
    size = sample.agg(F.sum("y"), F.count("*")).first()
    ones, zeros = int(size[0] or 0), int(size[1] - (size[0] or 0))
    if not ones or not zeros:
        return None
    share = (F.col("n1") + F.col("n0")) / F.lit(ones + zeros)
    gap = F.abs(F.col("n1") / F.lit(ones) - F.col("n0") / F.lit(zeros))
    counted = (sample.select("y", F.explode("feats").alias("feat")).groupBy("feat")
               .agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).filter("n1 + n0 >= 5")
               .select("feat", (gap / F.sqrt(share * (1.0001 - share))).alias("score")))
    chosen = [r[0] for r in counted.orderBy(F.desc("score"), "feat").limit(words).collect()]
    names = np.array(sorted({*chosen, *every}), np.int64)
    known = F.array(*(F.lit(int(f)) for f in names))
    got = sample.select("id", "y", F.array_intersect("feats", known).alias("feats")).orderBy(
        F.xxhash64("id"), "id").collect()
    x = np.zeros((len(got), len(names)), np.float64)
    y = np.zeros((len(got), len(NAMES)), np.float64)
    for i, r in enumerate(got):
        x[i, np.searchsorted(names, np.array(r["feats"], np.int64))] = 1
        y[i] = [*(float(r["y"] and not seed.isdisjoint(r["feats"])) for seed in seeds), float(r["y"])]
    return train_chain(names, x, y)


def score(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """(doc_id, insult, contempt, disgust, toxic, rejected) for every row of ``docs``.

    Probabilities per category; ``rejected`` is toxic >= ``threshold``. Whole texts are read. Null,
    empty and wordless texts have no features and get the chain's intercept. Without a chain (no
    labelled rows of both classes) all probabilities are 0 and nothing is rejected. Repeated rows
    and null ids each give a row, other columns are ignored, an empty table gives an empty result.
    """
    kind = "doc_id long, " + ", ".join(f"{n} double" for n in NAMES) + ", rejected boolean"
    names = {} if chain is None else {int(h): i for i, h in enumerate(chain.names)}

    def run(batches):
        for batch in batches:
            texts = arrow_bytes(batch.column(1))
            p = np.zeros((len(texts), len(NAMES)))
            if chain is not None:
                for at in range(0, len(texts), 1024):
                    part = texts[at:at + 1024]
                    x = np.zeros((len(part), len(names)))
                    for i, t in enumerate(part):
                        x[i, [j for f in features(t) if (j := names.get(_hash(f))) is not None]] = 1
                    p[at:at + len(part)] = chain.predict(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1])),
                 pa.array(p[:, -1] >= threshold if chain is not None else np.zeros(len(p), bool))],
                ["doc_id", *NAMES, "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, kind)


def drop_toxic(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """``docs`` without the texts the chain rejects, all columns kept; texts do not move."""
    if chain is None:
        return docs
    names = {int(h): i for i, h in enumerate(chain.names)}
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = arrow_bytes(batch.column(at).cast(pa.string()))
            keep = np.ones(len(texts), bool)
            for lo in range(0, len(texts), 1024):
                part = texts[lo:lo + 1024]
                x = np.zeros((len(part), len(names)))
                for i, t in enumerate(part):
                    x[i, [j for f in features(t) if (j := names.get(_hash(f))) is not None]] = 1
                keep[lo:lo + len(part)] = chain.predict(x)[:, -1] < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
