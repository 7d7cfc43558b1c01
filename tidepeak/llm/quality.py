"""Quality classifier: Bradley-Terry pairwise ranking.

Each document has a strength w * x of its features; a pair of a good and a bad document is won
by the good one with probability sigmoid(w * (x_good - x_bad)), and w minimises the logistic loss
over all pairs of all labelled documents. The threshold is a quantile of all their strengths: the share
of bad labels. Scores are sigmoids of strengths, placed so that the threshold scores THRESHOLD.

Each Newton step is one pass over the labelled documents' features: tasks add up count, features and their
products by label and narrow bin of strength, and the driver, which gets these sums alone (at most BINS bins a
label), weighs every bin of good ones against every bin of bad ones, at their mean strengths. No document or
pair is left out; what differs from pair by pair is the spread of strengths inside a bin.

Defined cases: null text counts as empty text and gets a score like any other; labels of unknown
documents, null labels and null ids are not learned from; without both labels every score is the
share of good labels (1 if there are none); repeated rows are treated alike, and of documents that
share an id one is learned from; an empty table gives no rows; texts of any length are read whole; other
columns are kept and do not take part, and one that has the name of the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepeak.llm.common import bound_batches, materialise, remainder

THRESHOLD = 0.7
STEPS, RIDGE, SMALL = 25, 1e-3, 1e-7
#: Bins of strength are this wide, or wider where there would be more than BINS.
WIDTH, BINS = 1 / 32, 8192

_SPACE = b" \t\n\r\x0b\x0c"
_ALNUM = bytes([*range(48, 58), *range(65, 91), *range(97, 123)])
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_STOPS = b".,"
FEATURES = ("log_bytes", "upper", "digit", "symbol", "stops", "word_bytes", "distinct_words", "distinct_lines", "line_words", "bare_words", "lowest_run", "common")


def features(text: str) -> list[float]:
    """Numbers that tell prose from shouting, tables, symbol noise and repetition."""
    b = text.encode()
    n = len(b) or 1
    without = lambda chars: len(b) - len(b.translate(None, chars))
    space, alnum, high = without(_SPACE), without(_ALNUM), without(_HIGH)
    stops = without(_STOPS)
    letters = alnum + high or 1
    words = b.split()
    k = len(words) or 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    m = len(lines) or 1
    distinct = len({*words})
    plain = sum(1 for w in words if w.isalpha())
    return [
        np.log1p(len(b)),
        without(_UPPER) / letters,
        without(_DIGIT) / n,
        (len(b) - space - alnum - high - stops) / n,
        stops / k,
        min(20.0, (len(b) - space) / k),
        distinct / k,
        len({*lines}) / m,
        np.log1p(k / m),
        plain / k,
        np.log1p(k) - np.log1p(distinct),
        sum(1 for w in words if len(w) <= 3) / k,
    ]


@dataclass
class Ranker:
    """Strength weights on standardised features, and the strength that scores THRESHOLD."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.strength(x) - self.cut
        return 1 / (1 + np.exp(-(raw + np.log(THRESHOLD / (1 - THRESHOLD))).clip(-30, 30)))


CLIP = 8.0


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return ((x - mean) / scale).clip(-CLIP, CLIP)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def bin_sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> dict[int, np.ndarray]:
    """By label of rows(quality, x): a row for each bin of strength with count, sums of features, and sums of their products."""
    k = len(w)
    upper = np.triu_indices(k)
    width = max(WIDTH, 2 * CLIP * float(np.abs(w).sum()) / (BINS - 2))
    names = [f"c{i}" for i in range(1 + k + len(upper[0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = standard(matrix(batch.column("x"), k), mean, scale)
            parts = np.concatenate([np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]], 1)
            places = np.stack([batch.column("quality").to_numpy().astype(int), np.floor(x @ w / width).astype(int)], 1)
            keys, inverse = np.unique(places, axis=0, return_inverse=True)
            added = np.zeros((len(keys), parts.shape[1]))
            np.add.at(added, inverse.ravel(), parts)
            for key, more in zip(map(tuple, keys.tolist()), added):
                sums[key] = sums[key] + more if key in sums else more
        if sums:
            table = np.stack(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int64()), *[pa.array(c) for c in table.T]], names=["quality", "bin", *names])

    parts = rows.mapInArrow(run, "quality int, bin long, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("quality", "bin").agg(*[F.sum(c).alias(c) for c in names]).orderBy("quality", "bin").collect()
    return {q: np.array([r[2:] for r in found if r[0] == q]) for q in (0, 1)}


def pair_loss(sums: dict[int, np.ndarray], w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of bins, its gradient and its Hessian, with the ridge."""
    k = len(w)
    upper = np.triu_indices(k)
    n = {q: s[:, 0] for q, s in sums.items()}
    x = {q: s[:, 1 : 1 + k] / s[:, :1] for q, s in sums.items()}
    square = {}
    for q, s in sums.items():
        square[q] = np.zeros((len(s), k, k))
        square[q][:, upper[0], upper[1]] = square[q][:, upper[1], upper[0]] = s[:, 1 + k :]
    at = {q: v @ w for q, v in x.items()}
    loss, gradient, hessian = 0.0, np.zeros(k), np.zeros((k, k))
    against = np.zeros(len(n[0]))
    for a in range(0, len(n[1]), 256):
        i = slice(a, a + 256)
        margin = at[1][i, None] - at[0][None]
        pairs = n[1][i, None] * n[0][None]
        lost = 1 / (1 + np.exp(margin.clip(-500, 500)))
        loss += float((pairs * np.logaddexp(0, -margin)).sum())
        weight = pairs * lost
        gradient += weight.sum(0) @ x[0] - weight.sum(1) @ x[1][i]
        curve = lost * (1 - lost)
        hessian += np.tensordot(curve @ n[0], square[1][i], 1)
        against += n[1][i] @ curve
        cross = x[1][i].T @ (pairs * curve) @ x[0]
        hessian -= cross + cross.T
    hessian += np.tensordot(against, square[0], 1)
    total = n[0].sum() * n[1].sum()
    return loss / total + RIDGE / 2 * float(w @ w), gradient / total + RIDGE * w, hessian / total + RIDGE * np.eye(k)


def weigh(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights of least loss: Newton steps, halved where one has not made the loss less."""
    base = w = np.zeros(len(mean))
    step, best = np.zeros(len(mean)), np.inf
    for _ in range(STEPS):
        loss, gradient, hessian = pair_loss(bin_sums(rows, mean, scale, w), w)
        if loss > best + SMALL:
            step = step / 2
        else:
            base, best, step = w, loss, -np.linalg.solve(hessian, gradient)
            if -gradient @ step < SMALL:  # what the step can still gain
                break
        w = base + step
    return base


def cut_of(strengths: DataFrame, counts: dict[int, int], bad_share: float) -> float:
    """The middle of the two strengths(quality, s) between which the share of bad labels is reached, each label weighing as much as its share.

    Histograms between the least and the greatest strength of one bin, until a single strength is left.
    """
    each = {1: (1 - bad_share) / counts[1], 0: bad_share / counts[0]}
    aim, below = bad_share - 1e-12, 0.0
    low, high = strengths.agg(F.min("s"), F.max("s")).first()
    while True:
        inside = strengths.where(F.col("s").between(low, high))
        place = F.least(F.lit(4095), F.floor((F.col("s") - low) / (high - low) * 4096)) if high > low else F.lit(0)
        found = inside.groupBy(place.alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect()
        for at, r in enumerate(found):
            held = r["good"] * each[1] + r["bad"] * each[0]
            if below + held >= aim or at == len(found) - 1:
                break
            below += held
        low, high = r["low"], r["high"]
        if low == high:
            break
    if below + held - each[0 if r["bad"] else 1] < aim:  # reached by the last of that strength
        following = strengths.where(F.col("s") > low).agg(F.min("s")).first()[0]
        return (low + following) / 2 if following is not None else low
    return low


def strength_column(x: Column, ranker: Ranker) -> Column:
    @F.arrow_udf("double")
    def quality_strength(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(ranker.strength(matrix(rows, len(ranker.mean))), pa.float64())

    return quality_strength(x)


def fit(rows: DataFrame, bad_share: float) -> Ranker | float:
    """Learns from all rows(quality, x) of features; bad_share is the quantile of the threshold. The share of good ones if one label lacks."""
    at = [F.get("x", F.lit(i)) for i in range(len(FEATURES))]
    known = rows.agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    counts = {0: known[0], 1: known[1]}
    if not counts[0] or not counts[1]:
        return float(counts[1] > 0)
    mean, scale = np.array(known[2 : 2 + len(at)]), np.array(known[2 + len(at) :]) + 1e-6
    ranker = Ranker(mean, scale, weigh(rows, mean, scale), 0.0)
    strengths = materialise(rows.select("quality", strength_column(F.col("x"), ranker).alias("s")), "quality-strengths")
    return replace(ranker, cut=cut_of(strengths, counts, bad_share))


def features_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def quality_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([features(t or "") for t in texts.to_pylist()], pa.list_(pa.float64()))

    return quality_features(text)


def score_column(x: Column, ranker: Ranker) -> Column:
    """Score of a column of features."""

    @F.arrow_udf("double")
    def quality_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(ranker.score(matrix(rows, len(ranker.mean))), pa.float64())

    return quality_score(x)


def learn_from(rows: DataFrame, labels: DataFrame) -> Ranker | float:
    """A ranker from stored features rows(doc_id, x) and labels(doc_id, quality); the share of good labels if one label lacks."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return float(counts.get(1, 1) > 0 and 0 not in counts)
    found = rows.join(known.distinct(), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    return fit(materialise(found.select(F.col("quality").cast("int").alias("quality"), "x"), "quality-known"), counts[0] / (counts[0] + counts[1]))


def learn(docs: DataFrame, labels: DataFrame) -> Ranker | float:
    """A ranker from all of docs(doc_id, text) that have labels(doc_id, quality); the share of good labels if one label lacks."""
    bound_batches(docs.sparkSession)
    return learn_from(docs.select("doc_id", features_column(F.col("text")).alias("x")), labels)


def scored(docs: DataFrame, ranker: Ranker | float, to: str = "score") -> DataFrame:
    """Adds the score of every whole text to docs(text, ...)."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(to, score_column(features_column(docs["text"]), ranker) if isinstance(ranker, Ranker) else F.lit(ranker))


def held_out_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted: learned only from rows whose id digest is not 2 modulo 4.

    Features are made once, and stored for learning and scoring.
    """
    bound_batches(docs.sparkSession)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = materialise(docs.select("doc_id", held_out.alias("held_out"), features_column(F.col("text")).alias("x")), "quality-features")
    ranker = learn_from(rows.select("doc_id", "x"), labels.where(remainder(F.col("doc_id"), 4) != 2))
    out = rows.withColumn("score", score_column(F.col("x"), ranker) if isinstance(ranker, Ranker) else F.lit(ranker)).drop("x")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
