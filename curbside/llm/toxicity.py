"""Toxicity scores from two class-conditional Kneser-Ney models.

A text becomes a sequence of symbols: lower-cased letters a to z, one blank for
each run of what is neither letter nor digit, and a fixed number of classes for
all other letters and digits. Expressions are runs of ``ORDER`` symbols, so that
a word is known whatever stands around it. Each class has its own counts of
documents that hold an expression; what the discount takes from them goes to
backoff counts that both classes share (Kneser-Ney continuation counts of the
lower orders, pooled). An expression that neither class knows well is thus
smoothed in the same way twice and says next to nothing.

The score compares the log-likelihoods of a text under the toxic and the
ordinary model, divided by its number of different expressions, and turns the
difference into a probability by a curve fitted to rows that were not counted.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.common import may_be_in, place_of, small_batches, texts

#: Symbols of an expression; the context is one shorter.
ORDER = 4
#: Size of the alphabet: the blank, a to z, and classes of other letters. A
#: model has SYMBOLS ** ORDER numbers at most, whatever the size of the corpus.
SYMBOLS = 48
DISCOUNT = 1.0
#: Scores from here on are predicted as toxic.
THRESHOLD = 0.7
#: Rows whose crc32 of the doc_id has this remainder by FOLDS are never learnt
#: from. Of the others those of CURVE fit the curve, the rest are counted.
FOLDS = 3
HELD_OUT = 1
CURVE_FOLDS, CURVE = 7, 0
#: Differences of log-likelihoods are told apart by this much in the curve.
GRAIN = 0.002

MARKS = re.compile(r"[\W_]+")


# --- texts as expressions ---------------------------------------------------


def symbols_of(text: str, symbols: int = SYMBOLS) -> np.ndarray:
    """0 for a blank, 1 to 26 for a to z, classes by code point for the rest.
    Blanks stand before (ORDER - 1 of them) and after the text."""
    words = MARKS.sub(" ", text.lower()).strip()
    if not words:
        return np.zeros(0, np.int64)
    codes = np.frombuffer((" " * (ORDER - 1) + words + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    other = 27 + codes % (symbols - 27)
    return np.where(codes == 32, 0, np.where((codes >= 97) & (codes <= 122), codes - 96, other))


def expressions_of(text: str, symbols: int = SYMBOLS) -> np.ndarray:
    """The different expressions of a text, as numbers in base ``symbols``."""
    s = symbols_of(text, symbols)
    if not len(s):
        return s
    number = s[: len(s) - ORDER + 1].copy()
    for k in range(1, ORDER):
        number = number * symbols + s[k : len(s) - ORDER + 1 + k]
    return np.unique(number)


# --- the model --------------------------------------------------------------


def shared_backoff(pooled: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """p(v | context) of the order below, from continuation counts: in how many
    contexts, of whatever class, something was met. Interpolated down to the
    even distribution. ``pooled`` has one axis for each symbol."""
    counts = (pooled > 0).sum(axis=0, dtype=np.float64)
    lower = shared_backoff(counts, discount) if counts.ndim > 1 else np.full(counts.shape, 1 / len(counts))
    total = counts.sum(axis=-1, keepdims=True)
    kept = np.maximum(counts - discount, 0)
    taken = total - kept.sum(axis=-1, keepdims=True)
    safe = np.where(total > 0, total, 1)
    return np.where(total > 0, kept / safe + taken / safe * lower, lower)


def class_model(counts: np.ndarray, backoff: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """p(v | context) of one class; what is discounted goes to ``backoff``."""
    total = counts.sum(axis=-1, keepdims=True, dtype=np.float64)
    kept = np.maximum(counts - discount, 0)
    taken = total - kept.sum(axis=-1, keepdims=True)
    safe = np.where(total > 0, total, 1)
    return np.where(total > 0, kept / safe + taken / safe * backoff, backoff)


def log_ratios(toxic: np.ndarray, ordinary: np.ndarray, symbols: int = SYMBOLS, discount: float = DISCOUNT) -> np.ndarray:
    """log p(expression | toxic) - log p(expression | ordinary) of all of them,
    from the documents of each class that hold them."""
    shape = (symbols,) * ORDER
    t, o = toxic.reshape(shape), ordinary.reshape(shape)
    backoff = shared_backoff(t + o, discount)
    out = np.empty(shape, np.float32)
    for first in range(symbols):  # one slice of contexts at a time
        p = class_model(t[first], backoff, discount)
        q = class_model(o[first], backoff, discount)
        out[first] = np.log(p / q)
    return out.ravel()


def difference(text: str, ratios: np.ndarray, symbols: int = SYMBOLS) -> float:
    """Length-normalised difference of the log-likelihoods; 0 without letters."""
    found = expressions_of(text, symbols)
    return float(ratios[found].mean(dtype=np.float64)) if len(found) else 0.0


@dataclass
class Curve:
    """Probability of the toxic label at a difference: a logistic step between
    the share of wrong labels on either side; a constant where nothing could
    be learnt."""

    middle: float = 0.0
    steep: float = 0.0
    low: float = 0.5
    high: float = 0.5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        step = 1 / (1 + np.exp(-np.clip(self.steep * (x - self.middle), -40, 40)))
        return self.low + (self.high - self.low) * step


def fit_curve(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> Curve:
    """The likeliest curve on a grid. ``x``: differences, ``ones`` and ``zeros``:
    how many rows of either label lie there."""
    n = ones + zeros
    if not n.sum():
        return Curve()
    share = float(ones.sum() / n.sum())
    if not ones.sum() or not zeros.sum():
        return Curve(low=share, high=share)
    order = np.argsort(x)
    x, ones, n = x[order], ones[order].astype(float), n[order].astype(float)
    reach = np.cumsum(n) / n.sum()
    spread = max(float(np.interp(0.95, reach, x) - np.interp(0.05, reach, x)), GRAIN)
    best, found = -np.inf, Curve(low=share, high=share)
    for middle in np.unique(np.interp(np.linspace(0.005, 0.995, 199), reach, x)):
        for steep in np.geomspace(4, 400, 15) / spread:
            step = 1 / (1 + np.exp(-np.clip(steep * (x - middle), -40, 40)))
            low = ((1 - step) * ones).sum() + 0.5
            high = (step * ones).sum() + 0.5
            low, high = low / (((1 - step) * n).sum() + 1), high / ((step * n).sum() + 1)
            if low >= high:
                continue
            p = low + (high - low) * step
            value = (ones * np.log(p) + (n - ones) * np.log1p(-p)).sum()
            if value > best:
                best, found = value, Curve(float(middle), float(steep), float(low), float(high))
    return found


# --- the job ----------------------------------------------------------------


def _crc():
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def fold():
    """Remainder of the crc32 of doc_id as text."""
    return _crc() % FOLDS


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, curve) of the rows that may be learnt from; several
    labels of one doc_id count as the highest."""
    learnt = labels.where("doc_id is not null and toxic is not null").where(fold() != HELD_OUT)
    one = learnt.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return one.select("doc_id", "toxic", (F.shiftright(_crc(), 8) % CURVE_FOLDS == CURVE).alias("curve"))


def labelled(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """(text, toxic, curve) of the rows of ``docs`` that have a usable label.

    Labels may be as many as documents, so they are joined, not broadcast. First
    a set of hashed ids of fixed size keeps back nearly all texts without a
    label; a set grown full would only cost shuffle, not rows.
    """
    labelled_id = may_be_in(usable, "doc_id")
    near = docs.select("doc_id", "text").where("doc_id is not null").where(labelled_id(place_of("doc_id")))
    return near.join(usable, "doc_id").select("text", "toxic", "curve")


def _count(symbols):
    def count(batches):
        """Documents of a partition that hold each expression, by class."""
        counts = np.zeros((2, symbols**ORDER), np.int32)
        for batch in batches:
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                counts[toxic, expressions_of(text, symbols)] += 1
        used = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.record_batch(
                [pa.array(part, pa.int32()), *[pa.array(counts[c, part], pa.int64()) for c in (1, 0)]],
                names=["expression", "toxic", "ordinary"],
            )

    return count


def train(docs: DataFrame, labels: DataFrame, symbols: int = SYMBOLS) -> tuple[np.ndarray, Curve]:
    """(ratios, curve). Counts come from every labelled text outside the held
    out rows, each expression counted once a document; to the driver come at
    most ``symbols`` ** ORDER sums, and one row for each GRAIN of the curve.
    """
    spark = docs.sparkSession
    rows = labelled(docs, usable_labels(labels))
    parts = rows.where("not curve").select("text", "toxic").mapInArrow(
        _count(symbols), "expression int, toxic bigint, ordinary bigint"
    )
    sums = parts.groupBy("expression").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    counts = np.zeros((2, symbols**ORDER), np.int64)
    for batch in sums.toArrow().to_batches():
        at = batch.column("expression").to_numpy()
        counts[0, at] = batch.column("toxic").to_numpy()
        counts[1, at] = batch.column("ordinary").to_numpy()
    ratios = log_ratios(counts[0], counts[1], symbols)
    del counts
    model = spark.sparkContext.broadcast(ratios)
    points = (
        rows.where("curve").select("toxic", F.round(difference_column(model, symbols)("text") / GRAIN).alias("place"))
        .groupBy("place").agg(F.sum("toxic").alias("ones"), F.count("*").alias("n")).collect()
    )
    model.destroy()
    points.sort()
    x, ones, n = (np.array([r[k] for r in points], dtype=float) for k in ("place", "ones", "n"))
    return ratios, fit_curve(x * GRAIN, ones, n - ones)


def difference_column(model, symbols: int = SYMBOLS):
    @F.arrow_udf(T.DoubleType())
    def compare(text: pa.Array) -> pa.Array:
        return pa.array([difference(t, model.value, symbols) for t in texts(text)], pa.float64())

    return compare


def toxicity_scores(docs: DataFrame, labels: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, held_out, difference, score and predicted of each row.

    ``labels``: doc_id, toxic; rows with a null in either are left out, several
    labels of one doc_id count as the highest. A null or empty text, or one
    without letters, has difference 0; a row without doc_id is not held out and
    not learnt from; repeated rows give a row each and count each time; without
    labels of both kinds every score is their share, or 0.5. Further columns are
    ignored, no rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ratios, curve = train(docs, labels, symbols)
    compare = difference_column(spark.sparkContext.broadcast(ratios), symbols)

    @F.arrow_udf(T.DoubleType())
    def likely(x: pa.Array) -> pa.Array:
        return pa.array(curve(x.to_numpy(zero_copy_only=False)), pa.float64())

    scored = docs.select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), compare("text").alias("difference")
    ).withColumn("score", likely("difference"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
