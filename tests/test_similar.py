"""Near duplicates against a plain loop over the rows in order."""

import random

import pytest

from curbside.functions.similarity import _common
from curbside.operators import similar


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        before = 0
        for j, other in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if ch == other else max(row[j], row[j - 1])
    return row[-1]


def alike(a, b, cutoff=90):
    total = len(a) + len(b)
    return total == 0 or 200 * lcs(a, b) > cutoff * total


def greedy(rows, cutoff=90):
    kept, pairs = [], []
    for o, t, p in sorted(rows):
        t = t or ""
        hit = next((k for k in kept if k[2] == p and alike(k[1], t, cutoff)), None)
        if hit:
            pairs.append((hit[0], o))
        else:
            kept.append((o, t, p))
    return {k[0] for k in kept}, pairs


def frame(spark, rows):
    return spark.createDataFrame(rows, "ordinal long, title string, raw_price string").repartition(5)


def edit(rng, text, n, letters):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars) + 1)
        if rng.random() < 0.5 and chars:
            del chars[at % len(chars)]
        else:
            chars.insert(at, rng.choice(letters))
    return "".join(chars)


def chains(seed, n, letters="abcde ", prices=("$1", "$2", None)):
    """Titles that drift away from each other step by step."""
    rng = random.Random(seed)
    titles = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 45))) for _ in range(4)]
    rows = []
    for o in range(n):
        base = rng.choice(titles)
        title = edit(rng, base, rng.choice([0, 1, 1, 2, 3, 5]), letters)
        titles.append(title)
        rows.append((o * 7, None if title == "" and o % 2 else title, rng.choice(prices)))
    return rows


def test_common_counts():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 80)))
        b = edit(rng, a, rng.randrange(0, 20), "abcé")
        assert _common(a, b) == lcs(a, b)


@pytest.mark.parametrize("seed,leaders", [(1, 256), (3, 8), (5, 40)])
def test_greedy_on_chains(spark, seed, leaders):
    rows = chains(seed, 120)
    want, pairs = greedy(rows)
    got = similar.dedup_similar(frame(spark, rows), leaders=leaders)
    assert {r["ordinal"] for r in got.collect()} == want
    assert 5 < len(want) < 110


@pytest.mark.parametrize("cutoff", [70, 95])
def test_other_cutoffs(spark, cutoff):
    rows = chains(11, 60)
    got = similar.dedup_similar(frame(spark, rows), cutoff=cutoff, leaders=10)
    assert {r["ordinal"] for r in got.collect()} == greedy(rows, cutoff)[0]


def test_one_large_price_of_copies_and_of_strangers(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, f"Charming 3 Bed House on Main Street, unit number {i}", None) for i in range(200)]
    rows += [(1000 + i, "".join(rng.choice("abcdefghij") for _ in range(30)), None) for i in range(60)]
    monkeypatch.setattr(similar, "ROWS_PER_TASK", 40)  # split large groups
    got = similar.dedup_similar(frame(spark, rows), leaders=16)
    assert {r["ordinal"] for r in got.collect()} == greedy(rows)[0]


def test_rounds_do_not_follow_the_rows(spark, monkeypatch):
    """Unlike titles of one price: as many checkpoints for more of them."""
    rng = random.Random(2)
    counts = []
    for size in (100, 400, 1600):
        rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(30)), None) for i in range(size)]
        made = []
        cut = similar.cut_lineage
        monkeypatch.setattr(similar, "cut_lineage", lambda df: made.append(1) or cut(df))
        assert similar.dedup_similar(frame(spark, rows)).count() == size
        monkeypatch.setattr(similar, "cut_lineage", cut)
        counts.append(len(made))
    assert len(set(counts)) == 1


def test_equal_ordinals_are_an_error(spark):
    with pytest.raises(ValueError, match="unique"):
        similar.dedup_similar(frame(spark, [(1, "a title", "$1"), (1, "another", "$1")]))


def test_fixed_cases(spark):
    a = "a" * 20
    rows = [
        (1, a, "$1"), (2, a + "bbb", "$1"), (3, a + "bbbbbb", "$1"),  # chain: 1 like 2, 2 like 3, 1 unlike 3
        (4, a, "$2"),  # other price
        (5, "same title", None), (6, "same title", None),  # null equals null
        (7, None, "$3"), (8, "", "$3"),  # null title equals empty title
        (9, "abcdefghij", "$4"), (10, "abcdefghiX", "$4"),  # exactly 90
        (11, "abcdefghijk", "$5"), (12, "abcdefghijX", "$5"),  # just above 90
    ]
    want, _ = greedy(rows)
    got = {r["ordinal"] for r in similar.dedup_similar(frame(spark, rows)).collect()}
    assert got == want == {1, 3, 4, 5, 7, 9, 10, 11}
    exact = {r["ordinal"] for r in similar.dedup_similar(frame(spark, rows), "exact").collect()}
    assert exact == {1, 2, 3, 4, 5, 7, 9, 10, 11, 12}


@pytest.mark.parametrize("leaders", [256, 20])
def test_pairs_name_the_first_kept_row(spark, leaders):
    rows = {}
    for o, t, p in chains(21, 120):
        rows.setdefault((t or "", p), (o, t or "", p))
    rows = list(rows.values())
    got = similar.similar_pairs(frame(spark, rows), leaders=leaders)
    assert {(r["a"], r["b"]) for r in got.collect()} == set(greedy(rows)[1])


def test_arguments(spark):
    with pytest.raises(ValueError):
        similar.dedup_similar(frame(spark, [(1, "a", "b")]), mode="other")
    assert similar.dedup_similar(frame(spark, [(1, "a", "b")])).count() == 1


def test_few_titles_at_many_prices(spark, monkeypatch):
    """Titles that come again at many prices are compared once for all of them,
    not in the fragments of each price; the outcome is that of the plain loop."""
    rng = random.Random(4)
    titles = [t or "" for _, t, _ in chains(31, 40)] + [f"{n}BR/1.5BA {kind} in {city}" for n in "?3456" for kind in ("house", "condo") for city in ("BUILDING", "MACHINERY")]
    rows = [(o, rng.choice(titles), rng.choice([None, *(f"${n}" for n in range(12))])) for o in range(1500)]
    monkeypatch.setattr(similar, "_fragment_groups", None)
    got = {r["ordinal"] for r in similar.dedup_similar(frame(spark, rows)).collect()}
    assert got == greedy(rows)[0]
    assert len(got) < len({(t, p) for _, t, p in rows})
