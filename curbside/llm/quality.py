"""Quality scores from random-indexing word vectors and a small network.

Tokens fall into buckets. The vector of a bucket is the sum, over the whole
corpus, of the index vectors of the tokens near its own: sparse random vectors
that follow from a seed. A document is the mean of its tokens' vectors, and a
two-layer network makes of it a probability, calibrated by one temperature.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.common import small_batches, texts

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 4096
SIZE = 64
#: Inputs of the network: the mean vector, its length, the share of repeats.
FEATURES = SIZE + 2
#: Entries of an index vector that are not zero, half of them negative.
SPARSE = 8
#: Tokens on either side whose index vectors are added.
REACH = 2
SEED = 20
#: The network learns from about this many labelled rows at most.
SAMPLE_ROWS = 20_000
HIDDEN = 32
EPOCHS = 40
BATCH = 256
#: Scores from here on are predicted as quality 1.
THRESHOLD = 0.3
#: Rows whose crc32 of the doc_id has this remainder by FOLDS are never learnt
#: from; those of the last remainder set the temperature.
FOLDS = 5
HELD_OUT = 0


#: Tokens whose buckets a worker remembers; long-lived workers keep them.
REMEMBERED = 60_000


class _Buckets(dict):
    """Bucket of each token met so far, emptied when it has grown large."""

    def __missing__(self, token):
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = bucket = zlib.crc32(token.encode()) % BUCKETS
        return bucket


_BUCKET = _Buckets()


def buckets_of(text: str) -> np.ndarray:
    tokens = TOKEN.findall(text)
    return np.fromiter(map(_BUCKET.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    places = rng.permuted(np.tile(np.arange(SIZE), (BUCKETS, 1)), axis=1)[:, :SPARSE]
    vectors = np.zeros((BUCKETS, SIZE))
    signs = np.where(np.arange(SPARSE) % 2, -1.0, 1.0)
    np.put_along_axis(vectors, places, signs[None, :], axis=1)
    return vectors


def _gather(batches):
    """Sums of the index vectors near each bucket, over one partition."""
    near = np.zeros(BUCKETS * BUCKETS, np.uint32)
    seen = False
    for batch in batches:
        for text in texts(batch.column(0)):
            w = buckets_of(text)
            seen = seen or len(w) > 1
            for step in range(1, REACH + 1):
                np.add.at(near, w[:-step] * BUCKETS + w[step:], 1)
    if not seen:
        return
    near, vectors = near.reshape(BUCKETS, BUCKETS), index_vectors()
    sums = np.empty((BUCKETS, SIZE))
    for at in range(0, BUCKETS, 512):
        rows = near[at : at + 512].astype(np.float64) + near[:, at : at + 512].T
        sums[at : at + 512] = rows @ vectors
    flat = pa.array(sums.ravel().astype(np.int64))
    yield pa.record_batch([
        pa.array(np.arange(BUCKETS, dtype=np.int32)),
        pa.ListArray.from_arrays(pa.array(np.arange(BUCKETS + 1, dtype=np.int32) * SIZE), flat),
    ], names=["bucket", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from every text. What comes to the driver
    is BUCKETS rows, whatever the size of the corpus."""
    parts = docs.select("text").mapInArrow(_gather, "bucket int, sums array<bigint>")
    total = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(SIZE)]).alias("sums"))
    vectors = np.zeros((BUCKETS, SIZE))
    for row in total.collect():
        vectors[row["bucket"]] = row["sums"]
    met = np.abs(vectors).sum(axis=1) > 0
    if met.any():
        vectors[met] /= np.linalg.norm(vectors[met], axis=1, keepdims=True)
        vectors[met] -= vectors[met].mean(axis=0)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def pooled(batch: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text with its length, and the share of tokens that
    repeat the one before: a text of a few words said over and over has a long
    mean, which a small network does not see. Zeros for a text without tokens.
    """
    counts, repeats = np.zeros((len(batch), BUCKETS)), np.zeros((len(batch), 1))
    for k, text in enumerate(batch):
        w = buckets_of(text)
        if len(w):
            counts[k] = np.bincount(w, minlength=BUCKETS) / len(w)
            repeats[k] = np.count_nonzero(w[1:] == w[:-1]) / len(w)
    mean = counts @ vectors
    return np.hstack([mean, np.linalg.norm(mean, axis=1, keepdims=True), repeats])


@dataclass
class Network:
    """tanh layer and logit over standardised inputs; a constant probability
    where the labels that could be learnt from are all alike or missing."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> Network:
    """Learns from the rows outside ``calibrate``, Adam over small batches, and
    takes the temperature that fits the rows inside best."""
    rng = np.random.default_rng(SEED)
    learn = ~calibrate
    size = x.shape[1]
    mean, scale = (x[learn].mean(0), x[learn].std(0) + 1e-9) if learn.any() else (np.zeros(size), np.ones(size))
    params = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    if len(set(y[learn].tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Network(mean, scale, params[0], params[1], params[2], 0.0, constant=share)
    z, t = (x[learn] - mean) / scale, y[learn].astype(float)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            a, b = z[rows], t[rows]
            h = np.tanh(a @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -40, 40)))
            d = (p - b) / len(rows)
            dh = np.outer(d, params[2]) * (1 - h * h)
            grads = [a.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    rows = calibrate if calibrate.any() else learn
    logits, truth = net.logits(x[rows]), y[rows]

    def loss(temperature):
        m = np.where(truth == 1, logits, -logits) / temperature
        return np.logaddexp(0, -m).mean()

    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def fold():
    """Remainder of the crc32 of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def _pool_column(vectors):
    @F.arrow_udf("array<double>")
    def pool(text: pa.Array) -> pa.Array:
        return pa.array(list(pooled(texts(text), vectors.value)), pa.list_(pa.float64()))

    return pool


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(vectors, network). ``labels``: doc_id, quality; rows with a null in
    either are left out, several labels of one doc_id count as the lowest.

    The network sees about ``sample_rows`` labelled rows at most, drawn by a
    hash of doc_id; that many doc_ids are broadcast and as many short vectors
    come to the driver. The word vectors come from every text.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    usable = (
        labels.where("doc_id is not null and quality is not null").where(fold() != HELD_OUT)
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    )
    count = usable.count()
    share = int(1_000_000 * min(1.0, sample_rows / max(count, 1)))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    shared = spark.sparkContext.broadcast(vectors)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
        .select("doc_id", "quality", (fold() == FOLDS - 1).alias("calibrate"), _pool_column(shared)("text").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), FEATURES)
    y = np.array([int(r["quality"] > 0) for r in rows], dtype=int)
    return vectors, fit(x, y, np.array([r["calibrate"] for r in rows], dtype=bool))


def quality_column(spark, vectors: np.ndarray, network: Network):
    """Column function: text to the probability that its quality is 1."""
    model = spark.sparkContext.broadcast((vectors, network))

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        own, net = model.value
        batch, out = texts(text), []
        for at in range(0, len(batch), 256):
            out.append(net.probability(pooled(batch[at : at + 256], own)))
        return pa.array(np.concatenate(out) if out else np.array([]), pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Null and empty texts are scored as texts without tokens; a row without
    doc_id is not held out; without labels of both kinds every score is their
    share, or 0.5; repeated rows give a row each.
    """
    small_batches(docs.sparkSession)
    score = quality_column(docs.sparkSession, *train(docs, labels, sample_rows))
    return docs.select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows whose text is predicted to have quality 0."""
    small_batches(docs.sparkSession)
    score = quality_column(docs.sparkSession, *train(docs, labels, sample_rows))
    return docs.where(score("text") >= THRESHOLD)
