"""Quality by weak supervision: rules vote, expectation-maximisation weighs them.

Each rule votes good or bad on a text, or abstains. How often a rule is right is not known;
expectation-maximisation estimates it from how the rules agree over all texts. A text is kept by its
posterior probability of being good, not because it passes every rule. The votes of
all texts are counted by pattern in Spark; the model is fitted on those counts, at most 3 ^ rules.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quitanda.llm.common import arrow_bytes, window_hashes, word_hashes
from quitanda.session import materialize

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_HAS_WORD = re.compile(rb"[^\x20\x09-\x0D]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_stops")


def measure(text: bytes | None, words: np.ndarray) -> tuple[int, ...]:
    """The COUNTS of a text, given the hashes of its words."""
    text = text or b""
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(byte[0x80:0xC0].sum()) - sum(int(byte[c]) for c in _SPACE)
    lines = [x for x in text.split(b"\n") if _HAS_WORD.search(x)]
    repeated = 0
    if len(words) >= 4:
        grams = window_hashes(words, 3)
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[i:i + len(grams)] |= twice
        repeated = int(covered.sum())
    return (len(words), chars, sum(int(byte[c]) for c in _SYMBOLS), len(lines) - len(set(lines)), repeated,
            len(lines), int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[46] + byte[33] + byte[63]))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS) for every row; null texts count as empty."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            rows = np.array([measure(t, w) for t, w in zip(arrow_bytes(texts), word_hashes(texts, lower=False))],
                            np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))],
                                             ["doc_id", *COUNTS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def vote(bad: Column | None, good: Column | None = None) -> Column:
    """-1 bad, 1 good, 0 abstain."""
    out = F.when(bad, -1) if bad is not None else None
    if good is not None:
        out = F.when(good, 1) if out is None else out.when(good, 1)
    return out.otherwise(0)


def rules() -> dict[str, Column]:
    """The voting rules over the COUNTS.

    A rule about one defect says "bad" where it finds it and has no opinion elsewhere: the lack of one
    defect says little. Only a text without any of them is called good.
    """
    n = F.col("n_words")
    letters = F.col("n_upper") + F.col("n_lower")
    tidy = ((n > 0) & (F.col("n_symbols") * 100 <= n) & (F.col("n_dup_lines") * 10 <= F.col("n_lines"))
            & (F.col("n_repeat_words") * 10 <= n) & (F.col("n_upper") * 10 <= letters))
    return {
        "tidy": vote(None, tidy),
        "sentences": vote((n >= 30) & (F.col("n_stops") * 100 < n), tidy & F.col("n_stops").between(F.ceil(n / 60), F.floor(n / 3))),
        "short": vote(n < 20),
        "word_length": vote((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        "symbols": vote(F.col("n_symbols") * 10 > n),
        "lines": vote(F.col("n_dup_lines") * 10 > 3 * F.col("n_lines")),
        "repeats": vote(F.col("n_repeat_words") * 10 > 3 * n),
        "capitals": vote(F.col("n_upper") * 10 > 4 * letters),
    }


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, accuracy: float = 0.9,
              weight: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of "good" per vote pattern, accuracy per rule), by expectation-maximisation.

    ``votes`` is patterns x rules of -1, 0, 1; each pattern occurred ``counts`` times. A vote of a rule
    that is right with probability a moves the log odds by log(a / (1 - a)); abstaining moves nothing.
    Neither class is favoured beforehand, and no rule is taken to be worse than chance. Accuracies start
    at ``accuracy``, held by ``weight`` pseudo-votes.
    """
    held = np.full(votes.shape[1], accuracy)
    cast = np.abs(votes).T @ counts
    for _ in range(rounds):
        posterior = 1 / (1 + np.exp(-(votes @ np.log(held / (1 - held)))))
        agree = np.where(votes > 0, posterior[:, None], np.where(votes < 0, 1 - posterior[:, None], 0.0))
        new = np.clip((agree.T @ counts + weight * accuracy) / (cast + weight), 0.5, 0.999)
        done = np.abs(new - held).max() < 1e-9
        held = new
        if done:
            break
    return posterior, held


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, COUNTS, base_failed, posterior, kept) for every row of ``docs``.

    ``base_failed``: under 50 words, or over half the words in three-word runs that come twice. A
    text is kept if it did not fail so and its posterior reaches ``threshold``. Null and empty texts
    have no words and fail. Repeated rows and null ids each give a row and count as texts; other
    columns are ignored; an empty table gives an empty result. Long texts are measured whole.
    """
    counted = measured(docs, id_col, text_col)
    names = list(rules())
    counted = materialize(counted.withColumns({f"v_{k}": v.cast("int") for k, v in rules().items()}), "quality-votes")
    patterns = counted.groupBy(*(f"v_{k}" for k in names)).count().collect()  # one row per pattern seen, at most 3 ^ rules
    spark = docs.sparkSession
    kind = ", ".join(f"v_{k} int" for k in names) + ", posterior double"
    if patterns:
        votes = np.array([r[:-1] for r in patterns], int)
        found, _ = fit_votes(votes, np.array([r[-1] for r in patterns], float))
        rows = [(*map(int, v), float(p)) for v, p in zip(votes, found)]
    else:
        rows = []
    by_pattern = spark.createDataFrame(rows, kind)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (counted.join(F.broadcast(by_pattern), [f"v_{k}" for k in names])
            .select("doc_id", *COUNTS, failed.alias("base_failed"), "posterior",
                    (~failed & (F.col("posterior") >= threshold)).alias("kept")))
