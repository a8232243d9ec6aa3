"""Problem 9: reading level by a familiar-word formula.

Familiar words are those in at least a fraction ``t`` of all documents. A text's difficulty is the
share of its words outside that list, together with its mean sentence length. The fraction ``t`` and
the weights of the formula are fitted to human ratings; everything else is counted over all documents.

The list is bounded: as a document has a bounded mean number of distinct words w, at most w / t words
can be in a fraction t of the documents.

Defined results: texts without words (null, empty, only digits or marks) have level null and are no
case. Ratings outside 1 to 5 and null are ignored, repeated rows count once, several raters of one
text are averaged. Without ratings of both kinds every level is null. Rows of null id are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.llm.common import reliable, spread

_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"(?:[.!?]+[\"')\]_*]*(?=\s|$|<)|\n\s*\n|[。！？])")
FRACTIONS = (0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.085, 0.1, 0.15, 0.2, 0.3, 0.5)
MAX_LABELLED = 50_000  # rated texts the formula is fitted to, the first by hash of the id
_FLUSH = 200_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def sentences(text: str) -> int:
    """Number of stretches between sentence ends that hold a word."""
    return max(1, sum(1 for s in _STOP.split(text) if _WORD.search(s)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(set(words(text)))
                seen[""] += 1
        if len(seen) > _FLUSH:
            yield out()
            seen.clear()
    if seen:
        yield out()


def familiar(documents: DataFrame, least: float = FRACTIONS[0]) -> dict[str, float]:
    """Words in at least a fraction ``least`` of all texts, with that fraction."""
    df = spread(documents.select("text")).mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    df = reliable(df)
    total = df.where("word = ''").select("n").first()
    if total is None:
        return {}
    rows = df.where((F.col("n") >= least * total["n"]) & (F.col("word") != "")).collect()
    return {r["word"]: r["n"] / total["n"] for r in rows}


def _measure(known: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = np.asarray(FRACTIONS)
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                ws = words(text) if text else []
                if ws:
                    f = np.fromiter((known.get(w, 0.0) for w in ws), float, len(ws))
                    f.sort()
                    rows.append((len(ws), len(ws) / sentences(text), (np.searchsorted(f, cut) / len(ws)).tolist()))
                else:
                    rows.append((0, None, None))
            n, s, u = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s, pa.float64()), pa.array(u, pa.list_(pa.float64()))], names=["doc_id", "domain", "n_words", "sentence_words", "unfamiliar"]
            )

    return run


def measures(documents: DataFrame, known: dict[str, float]) -> DataFrame:
    """``doc_id, domain, n_words, sentence_words, unfamiliar[]`` (a share for each of FRACTIONS)."""
    src = spread(documents.select("doc_id", "domain", "text"))
    return src.mapInArrow(_measure(known), "doc_id bigint, domain string, n_words bigint, sentence_words double, unfamiliar array<double>")


def _design(u: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(u)), u, np.log(s)])


def _logistic(z: np.ndarray, hard: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(z.shape[1])
    ridge = np.array([0.0, 1e-2, 1e-2])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
        w = np.clip(w + np.linalg.solve(h, z.T @ (weight * (hard - p)) - ridge * w), -200, 200)
    return w


def _cut(score: np.ndarray, hard: np.ndarray) -> tuple[float, int]:
    """Cut of the score with the fewest wrong ratings (the middle of its gap), and their number."""
    order = np.argsort(score, kind="stable")
    s, h = score[order], hard[order]
    # Wrong if the first i are called easy: the hard ones among them and the easy ones behind.
    wrong = np.append(0, np.cumsum(h)) + (len(h) - h.sum()) - np.append(0, np.cumsum(1 - h))
    wrong[1:-1][s[1:] == s[:-1]] = len(h) + 1
    i = int(wrong.argmin())
    return float((s[max(0, i - 1)] + s[min(len(s) - 1, i)]) / 2), int(wrong[i])


def fit(rated: list[tuple[list[float], float, float]]) -> dict | None:
    """Formula from (unfamiliar shares, sentence length, mean rating): the fraction and weights.

    ``hard`` are the weights of a logistic formula for level 4 and above, ``level`` those of a linear one
    for the level. Ratings that flatly contradict a first fit are raters' errors and get no weight in the second;
    the cut is then the one with the fewest wrong ratings. The fraction is the one with the fewest, then the
    least loss.
    """
    if not rated:
        return None
    shares = np.asarray([r[0] for r in rated])
    s, y = np.asarray([r[1] for r in rated]), np.asarray([r[2] for r in rated])
    hard = (y >= 3.5).astype(float)
    if hard.min() == hard.max():
        return None
    best = None
    for k in range(len(FRACTIONS)):
        x = _design(shares[:, k], s)
        scale = np.maximum(x.std(0), 1e-9)
        scale[0] = 1.0
        z = x / scale
        weight = np.ones(len(z))
        for _ in range(3):
            w = _logistic(z, hard, weight)
            p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-6, 1 - 1e-6)
            weight = (np.abs(hard - p) < 0.9).astype(float)
        cut, wrong = _cut(z @ w, hard)
        w[0] -= cut
        loss = -np.mean(hard * np.log(p) + (1 - hard) * np.log(1 - p))
        if best is None or (wrong, loss) < (best["wrong"], best["loss"]):
            level = np.linalg.lstsq(x, y, rcond=None)[0]
            best = {"k": k, "wrong": wrong, "loss": float(loss), "hard": (w / scale).tolist(), "level": level.tolist()}
    return best


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, domain, n_words, unfamiliar, sentence_words, hard, reading_level`` of every document.

    ``hard`` is the estimated probability that the text demands level 4 or more.
    """
    known = familiar(documents)
    m = reliable(measures(documents, known))
    rated = labels.where("reading_level between 1 and 5 and doc_id is not null").select("doc_id", "rater", "reading_level").distinct()
    rated = rated.groupBy("doc_id").agg(F.avg("reading_level").alias("y"))
    rows = m.where("n_words > 0").join(rated, "doc_id").orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED).select("unfamiliar", "sentence_words", "y").collect()
    model = fit([tuple(r) for r in rows])
    ok = F.col("n_words") > 0
    if model is None:
        null = F.lit(None).cast("double")
        return m.select("doc_id", "domain", "n_words", null.alias("unfamiliar"), "sentence_words", null.alias("hard"), F.lit(None).cast("int").alias("reading_level"))
    u = F.col("unfamiliar")[model["k"]]
    line = lambda w: F.lit(w[0]) + F.lit(w[1]) * u + F.lit(w[2]) * F.log("sentence_words")
    hard = F.when(ok, 1 / (1 + F.exp(-line(model["hard"]))))
    low = F.least(F.greatest(F.round(line(model["level"])), F.lit(1.0)), F.lit(5.0))
    # The level agrees with the decision at college level.
    level = F.when(hard >= 0.5, F.greatest(low, F.lit(4.0))).otherwise(F.least(low, F.lit(3.0))).cast("int")
    return m.select("doc_id", "domain", "n_words", u.alias("unfamiliar"), "sentence_words", hard.alias("hard"), F.when(ok, level).alias("reading_level"))
