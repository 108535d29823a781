"""Quality scores and benchmark passages."""

import random
import zlib

import numpy as np
import pytest
from llm_cases import ODD, documents

from curbside.llm import decontaminate, quality


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def labelled(spark, seed=1, n=400):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.8
        rows.append((i, " ".join(words) if good else " | ".join(words)))
        labels.append((i, int(good), 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(l[:2] for l in labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    out = quality.quality_scores(docs, labels).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    right = [r["predicted"] == truth[r["doc_id"]] for r in out if r["held_out"]]
    assert sum(right) / len(right) > 0.95


def test_held_out_labels_change_nothing(spark):
    docs, labels, truth = labelled(spark, n=150)
    turned = spark.createDataFrame(
        [(i, 1 - q if held_out(i) else q, 0) for i, q in truth.items()], "doc_id long, quality int, toxic int"
    )
    one, two = ({r["doc_id"]: r["score"] for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_word_vectors_are_sums_over_the_corpus(spark):
    rows = ODD + [(40, "a b c, a b"), (41, "b a")]
    vectors = np.zeros((quality.BUCKETS, quality.SIZE))
    index = quality.index_vectors()
    for _, text in rows:
        w = quality.buckets_of(text or "")
        for k in range(len(w)):
            for j in range(max(0, k - quality.REACH), min(len(w), k + quality.REACH + 1)):
                if j != k:
                    vectors[w[k]] += index[w[j]]
    met = np.abs(vectors).sum(axis=1) > 0
    vectors[met] /= np.linalg.norm(vectors[met], axis=1, keepdims=True)
    vectors[met] -= vectors[met].mean(axis=0)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    assert np.allclose(quality.word_vectors(documents(spark, rows)), vectors / np.where(length > 0, length, 1))


def test_odd_rows_and_labels(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 as score", "2 as quality")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    scores = {r["doc_id"]: r["score"] for r in out}
    assert scores[1] == scores[2] == scores[3]
    none = quality.quality_scores(docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(documents(spark, []), labels).count() == 0
    assert quality.keep_quality(docs, labels.where("false")).columns == docs.columns


def test_temperature_fits():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    net = quality.fit(x, y, np.arange(600) % 4 == 0)
    p = net.probability(x)
    assert abs(p.mean() - y.mean()) < 0.1 and ((p > 0.5) == y).mean() > 0.7


# --- benchmark passages -----------------------------------------------------


def brute_force(rows, items):
    """Items of which a text holds the shingles of question and answer."""
    out = set()
    for i, text in rows:
        words = decontaminate.words_of(text or "")
        for item, body in items:
            own = decontaminate.words_of(body or "")
            if item is None or not own:
                continue
            shares = []
            for side in decontaminate.question_answer(own):
                size = min(5, len(side))
                wanted = {tuple(side[k : k + size]) for k in range(len(side) - size + 1)}
                has = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
                shares.append(len(wanted & has) / len(wanted))
            if min(shares) >= 0.8:
                out.add((i, item))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 20, 50, 64, 65, 130, 300])))) for k in range(30)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 700))]
        if rng.random() < 0.5:
            body = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 8])):
                body[rng.randrange(len(body))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = body
        rows.append((i, " ".join(words).capitalize() + "."))
    return rows, items


def test_passages_like_brute_force(spark):
    rows, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_force(rows, items)
    assert len(expected) > 40
    found = decontaminate.contaminated(documents(spark, rows), table)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected
    parts = decontaminate.contaminated(documents(spark, rows), table, part_chars=3000)
    one, two = (sorted((r[0], r[1], round(r[2], 6), *r[3:]) for r in df.collect()) for df in (parts, found))
    assert one == two
    kept = decontaminate.without_benchmarks(documents(spark, rows), table)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in expected}


def test_retrieval_is_exact_above_the_threshold():
    """Block by block like every window against every segment in full."""
    rows, items = corpus(4)
    pieces = [s for _, t in items for s in decontaminate.segments_of(decontaminate.words_of(t))]
    frequency = {w: sum(w in p for p in pieces) for p in pieces for w in p}
    index = decontaminate.ItemIndex(items, frequency, len(pieces), np.mean([len(p) for p in pieces]))
    weights = [{} for _ in index.owner]
    for term, number in index.terms.items():
        for at in range(index.first[number], index.first[number + 1]):
            weights[index.segment[at]][term] = index.share[at]
    for _, text in rows[:40]:
        words = decontaminate.words_of(text)
        best = {}
        for a in range(0, max(1, len(words) - decontaminate.WINDOW + decontaminate.STRIDE), decontaminate.STRIDE):
            known = set(words[a : a + decontaminate.WINDOW])
            for number, own in enumerate(weights):
                share = sum(own[t] for t in known if t in own)
                if share >= decontaminate.RETRIEVED:
                    best[number] = max(share, best.get(number, 0))
        ids = np.fromiter(map(index.terms.__getitem__, words), np.int64, len(words))
        got = index.retrieve(ids)
        assert got.keys() == best.keys() and np.allclose([got[k] for k in best], list(best.values()))


@pytest.mark.parametrize("length", [20, 37, 59, 130])
def test_items_with_one_changed_word(spark, length):
    """Found wherever the word is, if 0.8 of all shingles are left."""
    item = [f"w{k}" for k in range(length)]
    rows = [(k, " ".join(["before", *item[:k], "changed", *item[k + 1 :], "after"])) for k in range(length)]
    rows.append((length, " ".join(item[: length * 3 // 4])))
    table = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    wanted = length - 4
    lost = [min(k, length - 5) - max(0, k - 4) + 1 for k in range(length)]
    expected = {k for k in range(length) if (wanted - lost[k]) / wanted >= 0.8}
    assert expected == set(range(length)) or length < 29
    found = decontaminate.contaminated(documents(spark, rows), table).collect()
    assert {r["doc_id"] for r in found} == expected and len(found) == len(expected)
    kept = decontaminate.without_benchmarks(documents(spark, rows), table)
    assert {r["doc_id"] for r in kept.collect()} == set(range(length + 1)) - expected


def test_question_and_answer_columns(spark):
    """Both have to be there where the item names them."""
    rng = random.Random(6)
    q, a = ([f"{k}{rng.randrange(900)}" for _ in range(30)] for k in "qa")
    items = spark.createDataFrame([("7", " ".join(q), " ".join(a)), ("x", "no id", "that is a number"), ("8", None, "only an answer of some words")],
                                  "item_id string, question string, answer string")
    bodies = [q + a, a + ["between"] + q, q, a, q + a[:20], q[:12] + a, "here is only an answer of some words".split(), []]
    docs = documents(spark, [(n, " ".join(b)) for n, b in enumerate(bodies)])
    for part_chars in (decontaminate.PART_CHARS, 60):
        found = decontaminate.contaminated(docs, items, part_chars, "question", "answer").collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 7), (1, 7), (6, 8)} and len(found) == 3
        kept = decontaminate.without_benchmarks(docs, items, part_chars, "question", "answer")
        assert {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 5, 7}
    loose = decontaminate.contaminated(docs, items, question="question", answer="answer", overlap=0.5).collect()
    assert {r["doc_id"] for r in loose if r["item_id"] == 7} == {0, 1, 4}


def test_parts_of_the_index_and_repeated_rows(spark):
    rows, items = corpus(3)
    table = spark.createDataFrame([(k % 25, t) for k, t in items], "item_id long, text string")
    docs = documents(spark, rows[:60] + rows[:10] + [(None, items[3][1]), (None, None)])
    one, several = (sorted(((r[0], r[1], round(r[2], 6), *r[3:]) for r in decontaminate.contaminated(docs, table, n).collect()), key=repr) for n in (10**9, 2500))
    assert one == several and len(one) > 20
    kept = [sorted((repr(tuple(r)) for r in decontaminate.without_benchmarks(docs, table, n).collect())) for n in (10**9, 2500)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < 72


def test_odd_passages(spark):
    items = [(1, "one"), (2, None), (None, "word word"), (3, ""), (4, "same id another text"), (4, "a text without an id"), (5, "...")]
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as part")
    docs = documents(spark, ODD).selectExpr("*", "1 as hit", "2 as item_id")
    out = decontaminate.contaminated(docs, table)
    assert sorted(((r["doc_id"], r["item_id"]) for r in out.collect()), key=repr) == sorted(
        [(5, 1), (5, 1), (6, 1), (7, 1), (7, 4), (None, 4)], key=repr
    )
    assert decontaminate.contaminated(docs, table.where("false")).count() == 0
    assert decontaminate.without_benchmarks(docs, table.where("false")).count() == len(ODD)
    assert decontaminate.contaminated(documents(spark, []), table).count() == 0
