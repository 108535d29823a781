"""Toxicity scores: the models against plain Kneser-Ney, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from llm_cases import ODD, documents
from pyspark.sql import functions as F

from curbside.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"
RUDE = ["grobian", "wretchling", "oafdom", "cadaver"]


def labelled(spark, seed=1, n=600):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(15, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for k in rng.sample(range(len(words)), max(2, len(words) // 25)):
                words[k] = rng.choice(RUDE).upper() if rng.random() < 0.2 else rng.choice(RUDE) + rng.choice(["", "###", ","])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS), {i: t for i, _, t in labels}, dict(rows)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs, labels, truth, _ = labelled(spark, n=1500)
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == len(truth)
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    unseen = [r for r in out if r["held_out"]]
    assert len(unseen) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in unseen) / len(unseen) > 0.97


def test_held_out_labels_change_nothing(spark):
    docs, labels, truth, _ = labelled(spark, n=150)
    turned = spark.createDataFrame([(i, 1, 1 - t if held_out(i) else t) for i, t in truth.items()], LABELS)
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, x).collect()} for x in (labels, turned))
    assert one == two


def plain_ratios(texts, size):
    """By dictionaries over tuples of symbols, one expression at a time."""
    counts = [Counter(), Counter()]
    for text, toxic in texts:
        s = tuple(toxicity.symbols_of(text, size).tolist())
        counts[toxic].update({s[k : k + 4] for k in range(len(s) - 3)})
    levels = [set(counts[0]) | set(counts[1])]
    for _ in range(3):
        levels.append({g[1:] for g in levels[-1]})
    # in how many contexts of one more symbol was a shorter run met
    met = [Counter(g[1:] for g in level) for level in levels[:3]]

    def shared(gram):
        if not gram:
            return 1 / size
        found = met[3 - len(gram)]
        family = [found[(*gram[:-1], v)] for v in range(size)]
        total = sum(family)
        if not total:
            return shared(gram[1:])
        kept = [max(c - 1, 0) for c in family]
        return kept[gram[-1]] / total + (total - sum(kept)) / total * shared(gram[1:])

    def own(c, gram):
        family = [counts[c][(*gram[:-1], v)] for v in range(size)]
        total = sum(family)
        if not total:
            return shared(gram[1:])
        kept = [max(n - 1, 0) for n in family]
        return kept[gram[-1]] / total + (total - sum(kept)) / total * shared(gram[1:])

    return lambda gram: math.log(own(1, gram) / own(0, gram))


def test_model_and_counts_like_plain_kneser_ney(spark):
    docs, labels, truth, text = labelled(spark, n=60)
    ratios, _ = toxicity.train(docs, labels, 30)
    curve = {
        r["doc_id"] for r in labels.select("doc_id", F.expr("shiftright(crc32(cast(cast(doc_id as string) as binary)), 8) % 7 = 0").alias("c")).where("c").collect()
    }
    learnt = [(text[i], t) for i, t in truth.items() if not held_out(i) and i not in curve]
    plain = plain_ratios(learnt, 30)
    rng = random.Random(2)
    grams = [tuple(rng.randrange(30) for _ in range(4)) for _ in range(200)]
    for body, _ in learnt[:6]:
        s = toxicity.symbols_of(body, 30).tolist()
        grams += [tuple(s[k : k + 4]) for k in range(0, len(s) - 3, 7)]
    for g in grams:
        assert abs(ratios[((g[0] * 30 + g[1]) * 30 + g[2]) * 30 + g[3]] - plain(g)) < 1e-4
    body = learnt[0][0]
    s = toxicity.symbols_of(body, 30).tolist()
    own = {tuple(s[k : k + 4]) for k in range(len(s) - 3)}
    assert abs(toxicity.difference(body, ratios, 30) - sum(map(plain, own)) / len(own)) < 1e-4


def test_classes_are_distributions():
    rng = np.random.default_rng(3)
    t, o = (rng.integers(0, 4, (7,) * 4) * (rng.random((7,) * 4) < 0.3) for _ in range(2))
    backoff = toxicity.shared_backoff(t + o)
    assert np.allclose(backoff.sum(axis=-1), 1)
    for c in (t, o):
        for first in range(7):
            p = toxicity.class_model(c[first], backoff)
            assert np.allclose(p.sum(axis=-1), 1) and (p > 0).all()


def test_rare_expressions_say_nothing():
    t, o = np.zeros((2, 30**4), np.int64)
    t[12345] = 1
    ratios = toxicity.log_ratios(t, o, 30)
    assert abs(ratios).max() < 1e-6


def test_symbols():
    assert toxicity.symbols_of("  A--b_ ").tolist() == [0, 0, 0, 1, 0, 2, 0]
    assert len(toxicity.symbols_of("-- \n")) == 0 and len(toxicity.symbols_of("")) == 0
    assert toxicity.symbols_of("é你😀", 48).max() < 48
    long = "word " * 200_000
    assert len(toxicity.expressions_of(long)) == len(toxicity.expressions_of("word word word"))


def test_odd_rows_and_labels(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 as score", "2 as toxic", "3 as difference")
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, 1, None), (5, 1, 0), (5, 0, 1), (8, 1, 0), (77, 1, 1)], LABELS
    ).selectExpr("*", "'x' as text")
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    scores = {r["doc_id"]: r["score"] for r in out}
    assert scores[1] == scores[2] == scores[3]
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.where("false")).collect()} == {0.5}
    alike = toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()
    assert len({r["score"] for r in alike}) == 1
    assert toxicity.toxicity_scores(documents(spark, []), labels).count() == 0


def test_curve_of_labels():
    x, ones, zeros = np.array([-1.0, 0.0, 1.0, 2.0]), np.array([0, 2, 30, 50]), np.array([100, 80, 1, 0])
    curve = toxicity.fit_curve(x, ones, zeros)
    p = curve(x)
    assert (np.diff(p) >= 0).all() and p[0] < 0.1 and p[3] > 0.9
    assert toxicity.fit_curve(x, ones, ones * 0)(x).tolist() == [1.0] * 4
    assert toxicity.fit_curve(x[:0], ones[:0], ones[:0])(x).tolist() == [0.5] * 4
