import random
import re

import numpy as np
import xxhash
from llm_cases import ODD, documents

from curbside.llm import simhash
from curbside.llm.components import components


def print_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_force(rows):
    """(doc_id, fingerprint, smallest linked id) by comparing all pairs."""
    prints = np.array([print_of(t) for _, t in rows], dtype=np.uint64)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[k + 1 :] ^ prints[k]) <= 4) + k + 1:
            root[find(int(j))] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f"{int(prints[k]):016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near_copies(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(150)] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    return rows


def test_odd_rows(spark):
    assert got(simhash.simhash_groups(documents(spark, ODD))) == brute_force(ODD)


def test_empty_table(spark):
    out = simhash.simhash_groups(documents(spark, []))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_near_copies_in_tiles(spark):
    rows = near_copies(3, 12, 25)
    expected = brute_force(rows)
    assert len({r[2] for r in expected}) < len(rows)
    assert got(simhash.simhash_groups(documents(spark, rows))) == expected
    assert got(simhash.simhash_groups(documents(spark, rows), tile_rows=6)) == expected


def test_anchors_meet_every_pair():
    """Any two values of a block that differ in one bit: one's home is in the
    other's reach."""
    rng = random.Random(5)
    for bits in (21, 22):
        masks = simhash.flips(bits)
        assert all(m[0].bit_count() <= 1 for m in masks)
        for _ in range(300):
            x = rng.getrandbits(bits)
            y = x ^ (1 << rng.randrange(bits))
            home = x ^ masks[simhash._syndrome(x & 0x7FFF)][0]
            assert simhash._syndrome(home & 0x7FFF) == 0
            assert home in [y ^ m for m in masks[simhash._syndrome(y & 0x7FFF)]]


def test_components_of_chains_and_hubs(spark):
    chain = [(k + 1, k) for k in range(40)]
    hub = [(k, 100) for k in range(101, 160)] + [(300, 150), (300, 101), (301, 300), (301, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(chain + hub, "u long, v long")).collect()))
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in [*range(101, 160), 300, 301]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_of_group(spark):
    rows = [(4, "a b c d e f"), (2, "A b  c d e f"), (2, "A b  c d e f"), (9, "quite another text of words"), (None, "a b c d e f")]
    docs = documents(spark, rows).selectExpr("*", "1 as kept_id", "'x' as row", "2 as fp", "map('a', 1) as m")
    out = simhash.keep_one_of_group(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(
        [(2, "A b  c d e f"), (9, "quite another text of words")], key=repr
    )


def test_keep_one_of_groups_that_share_an_id(spark):
    """Each group keeps a document, also where doc_ids repeat or are null."""
    rows = [
        (5, "a b c d e f"), (5, "quite another text of words"), (6, "quite another text of words"), (7, "A b c  d e f"),
        (None, "no id here but some words"), (None, "no id here but some words"), (None, "No id here  but some words"),
    ]
    out = simhash.keep_one_of_group(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted(
        [(5, "a b c d e f"), (5, "quite another text of words"), (None, "No id here  but some words")], key=repr
    )


def test_keep_one_of_group_like_brute_force(spark):
    """Near copies, copies stored again under other ids, the same id, or none."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))) for _ in range(12)] + ["", None]
    rows = []
    for _ in range(90):
        i, t = rng.choice([None, *range(25)]), rng.choice(texts)
        rows.append((i, t if t is None or rng.random() < 0.7 else t.upper()))
    rows += [(7, texts[0])] * 40
    prints = np.array([simhash.fingerprint_of((t or "").encode()) for _, t in rows]).view(np.uint64)
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in np.flatnonzero(np.bitwise_count(prints ^ p) <= 4)) for p in prints]
    want = {}
    for (i, t), g in zip(rows, group):
        want[g] = min(want.get(g, (True, 0, "~")), (i is None, i or 0, t or ""))
    out = [(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in simhash.keep_one_of_group(documents(spark, rows, 5)).collect()]
    assert sorted(out) == sorted(want.values()) and len(out) < len(set(rows))
