"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Each labelled good document is preferred to labelled bad ones; the score weights maximise the logistic
likelihood of those preferences, that is of w . (good - bad) (Newton's method, ridge penalty). The
threshold is the score quantile that the share of bad labels gives, and scores are shifted so that this
quantile maps to 0.7 of a logistic curve.

The fit uses at most max_labelled rows of each label (picked by a hash of doc_id, documented bound);
the quantile is that of all labelled rows outside the held-out quarter. Scoring reads every row and whole texts. Inputs are text statistics only.

Null and empty texts get the score of a text without any words. Labels that are null or of unknown
documents are ignored; of several labels of a document the largest counts, of several texts under a
labelled id the one with the least features teaches (all of them count for the quantile). Without both labels nothing
can be ranked: every score is 0.7 and nothing is rejected. Rows are independent: repeated rows, null
ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep, text_or_empty

CUT = 0.7
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_STOPS = [ord(c) for c in ".,;:!?'\"()-"]
_SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS]


def features(text: bytes) -> list[float]:
    """Statistics of a text that junk moves: symbols, capitals, digits, repetition, word and line shape."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), max(1, len(text))
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum()
    symbols = counts[_SYMBOLS].sum() / size
    upper = counts[_UPPER].sum() / max(1, letters)
    distinct = len(set(words))
    repeat = sum(map(eq, words, islice(words, 1, None))) / max(1, n - 1)
    herdan = math.log(distinct + 1) / math.log(n + 1) if n else 1.0
    mean = (size - counts[[32, 10, 9, 13]].sum()) / max(1, n)
    return [
        min(symbols, 0.05) * 20, symbols, min(upper, 0.3), max(0.0, upper - 0.3), counts[_DIGIT].sum() / size,
        min(repeat, 0.1) * 10, repeat, 1 - herdan, max(0.0, 0.85 - herdan), 1 - distinct / max(1, n),
        min(mean, 15.0) / 15, math.log1p(n) / 10, counts[_STOPS].sum() / size, counts[10] / size, float(n == 0),
    ]


N_FEATURES = len(features(b""))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -30, 30)) * (1 - CUT) / CUT)


def fit_ranking(x: np.ndarray, good: np.ndarray, pairs_each: int = 48, ridge: float = 1e-3) -> Ranking:
    """x: a row of features for each labelled document. The threshold is still to be set."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    # every document of the rarer label meets pairs_each of the other, spread evenly
    few, many = (down, up) if len(down) <= len(up) else (up, down)
    a = np.repeat(few, pairs_each)
    b = many[(np.arange(len(a)) * 7919) % len(many)]
    d = z[b] - z[a] if few is down else z[a] - z[b]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance given to the wrong order
        gradient = d.T @ p / len(d) - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return Ranking(mean, scale, w, 0.0)


#: Scores that the driver sorts; more are narrowed down by histograms first.
FEW_SCORES, BINS = 20_000, 1024


def neighbours_at(scores: DataFrame, k: int) -> tuple[float, float]:
    """The k-th and the next smallest value (from 0) of the column raw; exact, the driver gets FEW_SCORES rows or BINS counts at most."""
    while True:
        n, low, high = scores.agg(F.count("*"), F.min("raw"), F.max("raw")).first()
        if n <= FEW_SCORES:
            found = sorted(r["raw"] for r in scores.collect())
            return found[k], found[k + 1]
        place = F.least(F.floor((F.col("raw") - low) / F.lit((high - low) / BINS or 1.0)), F.lit(BINS - 1))
        bins = sorted(map(tuple, scores.groupBy(place.alias("bin")).agg(F.count("*"), F.min("raw"), F.max("raw")).collect()))
        ends = np.cumsum([b[1] for b in bins])
        first, second = (int(np.searchsorted(ends, i, side="right")) for i in (k, k + 1))
        if all(bins[b][2] == bins[b][3] for b in (first, second)):
            return bins[first][2], bins[second][2]
        scores = scores.where(F.col("raw").between(bins[first][2], bins[second][3]))
        k -= int(ends[first]) - bins[first][1]


def label_threshold(docs: DataFrame, known: DataFrame, ranking: Ranking) -> float:
    """Between the scores of as many labelled rows as are bad and the next one. Texts stay where they are: only scores meet labels."""

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t.as_buffer().to_pybytes()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
            raw = ((x - ranking.mean) / ranking.scale * ranking.weights).sum(1)  # equal texts have equal scores in any batch
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], names=["doc_id", "raw"])

        return step

    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    scores = keep(arrow_map(texts, "doc_id long, raw double", work).join(known, "doc_id").select("doc_id", "quality", "raw").distinct(), "label_scores")
    low, high = neighbours_at(scores.select("raw"), scores.where("quality < 1").count() - 1)
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000) -> Ranking | None:
    """Fit on labels outside the held-out quarter, at most max_labelled rows of each label; the threshold is of all of them."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pick = F.xxhash64(F.col("doc_id"), F.lit(17))
    sample = known.where("quality >= 1").orderBy(pick, "doc_id").limit(max_labelled).unionByName(known.where("quality < 1").orderBy(pick, "doc_id").limit(max_labelled))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [features(t.as_buffer().to_pybytes()) for t in batch.column(2)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

        return step

    found = arrow_map(texts, "doc_id long, quality int, x array<double>", work).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])  # 2 * max_labelled at most
    good = np.array([r["quality"] >= 1 for r in rows])
    if not len(rows) or good.all() or not good.any():
        return None
    ranking = fit_ranking(np.array([r["x"] for r in rows]), good)
    return replace(ranking, threshold=label_threshold(docs, known, ranking))


def score_documents(docs: DataFrame, ranking: Ranking | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns in carry for every row of docs."""

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t.as_buffer().to_pybytes()) for t in batch.column(2)]).reshape(-1, N_FEATURES)
            score = ranking.scores(x) if ranking is not None else np.full(len(x), CUT)
            made = [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32), pa.int32())]
            return pa.RecordBatch.from_arrays(made + [batch.column(3 + i) for i in range(len(carry))], names=["doc_id", "held_out", "score", "predicted", *carry])

        return step

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_or_empty().alias("_text"), *carry)
    schema = "doc_id long, held_out boolean, score double, predicted int" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return arrow_map(rows, schema, work)
