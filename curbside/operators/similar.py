"""Near-duplicate listings: greedy, first seen wins.

A row goes when an earlier *kept* row has the same raw price (null equals
null) and a title with a ratio above the cutoff. The relation is not
transitive, so the outcome is that of going through the rows in order.

How it stays parallel:

* equal titles at one price collapse to the first, with partial aggregation;
* pairs are looked for only inside *groups*, which are fragments of a price. If
  two titles differ by fewer than ``d`` insertions and deletions, then of any
  ``d`` disjoint fragments of one at least one is a fragment of the other. Each
  title therefore takes its fragments in one order for all, the rarest first,
  and only so many that ``d`` disjoint ones are among them: of a similar pair
  the title whose share ends first has a fragment there that the other has too.
  What occurs once in all titles counts for this share but makes no group, so
  unlike titles mostly need none, and common phrases are hardly ever reached;
* in a group the first ``leaders`` rows are compared with the rest, so a group
  of near copies costs rows times leaders, not their square: its first row
  removes the others. A row among the leaders of all its groups can be decided
  now; the others wait for the next round, which has GROWTH times as many
  leaders. Rounds follow the logarithm of the largest group of unlike titles;
* a few titles that come again at many prices share nearly all their fragments,
  and each price would compare them anew. Up to FEW_TITLES titles are therefore
  compared once for all prices, and each price is gone through in order with
  what the titles resemble; it has at most that many rows.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside import fixed_values as fv
from curbside.functions.order import check_unique
from curbside.functions.similarity import char_mask, with_similarity
from curbside.operators.dedup import first_per
from curbside.session import cut_lineage

GROUP_LEADERS = 1000
GROWTH = 4
ROWS_PER_TASK = 50_000
#: Longest fragments. They are chosen so that a title has SLACK times the
#: disjoint ones it needs: with fewer it could not leave the common ones out.
WIDTH, SLACK = 4, 1.25
#: Titles up to this length leave common fragments out.
LONGEST = 2000
#: Titles that are compared once for all prices: up to so many of them, with up
#: to so many similar pairs, each title at REPEATED prices in the mean.
FEW_TITLES, FEW_PAIRS, REPEATED = 2000, 100_000, 4


def _distinct_titles(df: DataFrame) -> DataFrame:
    """First ordinal of each title and price, with length and character set."""
    title = F.coalesce("title", F.lit("")).alias("t")
    firsts = df.groupBy(title, F.col("raw_price").alias("p")).agg(F.min("ordinal").alias("ordinal"))
    return firsts.select(
        "ordinal", "t", "p", F.length("t").alias("n"), F.expr(char_mask("t")).alias("mask")
    )


def _near(cutoff: int):
    """Cheap bounds on (a, b), a before b: by length and by character set."""
    room, total = F.lit(100 - cutoff), F.col("a.n") + F.col("b.n")
    return (
        (F.col("a.ordinal") < F.col("b.ordinal"))
        & (F.abs(F.col("a.n") - F.col("b.n")) * 100 < room * total)
        & (F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))) * 100 < room * total)
    )


def _needed(n: int, cutoff: int) -> int:
    """Disjoint fragments of which a partner of a title of ``n`` characters, or
    of a shorter one's longer partner, keeps at least one."""
    return -(-2 * (100 - cutoff) * n // cutoff)


def _width(n: int, cutoff: int) -> int:
    return next((w for w in range(WIDTH, 1, -1) if n >= SLACK * w * _needed(n, cutoff)), 1)


def _widths(cutoff: int) -> list[tuple[int, int, int]]:
    """(width, least, most): lengths of titles that need fragments of a width,
    as the shorter title of a pair, whose length chooses it, or as the longer.
    Beyond LONGEST characters all widths are taken."""
    room, found = 100 - cutoff, {}
    for n in range(1, LONGEST + 1):
        found.setdefault(_width(n, cutoff), []).append(n)
    reach = (100 + room) / (100 - room)
    return [(w, ns[0], 1 << 30 if ns[-1] * reach >= LONGEST else int(ns[-1] * reach) + 1) for w, ns in found.items()]


def _rare_share(cutoff: int) -> str:
    """SQL for the keys that a title takes from ``all``, its (f, key, at) of one
    width ``w`` in order: up to the place where ``d`` disjoint ones are among
    them, found by halving; all of them where that is nowhere."""
    disjoint = (
        "aggregate(array_sort(transform(slice(all, 1, int((s.low + s.high) div 2)), g -> g.at)), "
        "named_struct('last', -w, 'n', 0), (t, at) -> if(at >= t.last + w, named_struct('last', at, 'n', t.n + 1), t)).n"
    )
    halved = (
        f"if(s.low >= s.high, s, if({disjoint} >= d, named_struct('low', s.low, 'high', int((s.low + s.high) div 2)), "
        "named_struct('low', int((s.low + s.high) div 2) + 1, 'high', s.high)))"
    )
    steps = LONGEST.bit_length() + 1
    place = f"aggregate(sequence(1, {steps}), named_struct('low', least(d, size(all)), 'high', size(all)), (s, step) -> {halved}).high"
    return (
        f"array_distinct(transform(filter(if(n > {LONGEST}, all, slice(all, 1, {place})), g -> g.f > 1), g -> g.key))"
    )


def _fragment_groups(reps: DataFrame, cutoff: int) -> DataFrame:
    """(key, ordinal, n, mask) of every title in each of its groups."""
    room = 100 - cutoff
    needed = F.expr(f"cast(ceil({2 * room} * n / {cutoff}) as int)")
    # With d = 1 no difference is allowed, and equal titles are one row by now.
    titles = reps.withColumn("d", needed).where("d > 1")
    used = ", ".join(
        f"case when n > {LONGEST} or n between {low} and {high} then {w} end" for w, low, high in _widths(cutoff)
    )
    fragments = F.expr(
        f"flatten(transform(filter(array({used}), w -> w <= n), w -> transform(sequence(0, n - w), "
        "i -> named_struct('w', w, 'at', i, 'key', xxhash64(p, w, substring(t, i + 1, w))))))"
    )
    grams = titles.select("ordinal", F.explode(fragments).alias("g")).select("ordinal", "g.*")
    common = grams.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    ranked = grams.join(common, "key", "left").withColumn("f", F.coalesce("f", F.lit(1)))
    # As many as a title has characters.
    own = ranked.groupBy("ordinal", "w").agg(F.sort_array(F.collect_list(F.struct("f", "key", "at"))).alias("all"))
    taken = own.join(titles.select("ordinal", "n", "mask", "d"), "ordinal").select(
        "ordinal", "n", "mask", F.explode(F.expr(_rare_share(cutoff))).alias("key")
    )
    return taken


def _live(groups: DataFrame) -> DataFrame:
    """Groups that can hold a pair, with their number of ``rows`` and that of the
    ``parts`` that a large one is split into."""
    groups = groups.select("key", "ordinal", "n", "mask")
    sizes = groups.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    parts = F.ceil(F.col("rows") / ROWS_PER_TASK).cast("int").alias("parts")
    return groups.join(sizes.select("key", "rows", parts), "key")


def _fragment_pairs(heads: DataFrame, rows: DataFrame, reps: DataFrame, cutoff: int) -> DataFrame:
    """Similar pairs of one price that share a fragment, with a in heads. The
    rows of a large group go to several tasks, each with a copy of its heads."""
    rows = rows.withColumn("part", F.expr("pmod(hash(ordinal), parts)"))
    heads = heads.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    near = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & _near(cutoff)
    )
    found = (
        rows.alias("b").join(heads.alias("a"), near)
        .select(F.col("a.ordinal").alias("a"), F.col("b.ordinal").alias("b")).distinct()
    )
    left = reps.select(F.col("ordinal").alias("a"), F.col("t").alias("ta"), F.col("p").alias("pa"))
    right = reps.select(F.col("ordinal").alias("b"), F.col("t").alias("tb"), F.col("p").alias("pb"))
    texts = found.join(left, "a").join(right, "b").where(F.col("pa").eqNullSafe(F.col("pb")))
    return with_similarity(texts, "ta", "tb", cutoff).select("a", "b")


def _settle(pairs: DataFrame, waiting: DataFrame | None):
    """Greedy outcome over the pairs: the rows that go, and the pairs left
    undecided because they hang on a waiting row."""
    gone, pairs = [], cut_lineage(pairs)
    while True:
        # A row without an earlier rival stays, and its later rivals go.
        blocked = pairs.select(F.col("b").alias("a")).distinct()
        if waiting is not None:
            blocked = blocked.unionByName(waiting.select(F.col("ordinal").alias("a"))).distinct()
        blocked = blocked.withColumn("blocked", F.lit(True))
        judged = cut_lineage(pairs.join(blocked, "a", "left"))
        out = judged.where("blocked is null").select(F.col("b").alias("ordinal")).distinct()
        if out.isEmpty():
            return gone, judged.select("a", "b")
        gone.append(out)
        rest = judged.where("blocked").select("a", "b")
        rest = rest.join(out.select(F.col("ordinal").alias("b")), "b", "left_anti")
        pairs = rest.join(out.select(F.col("ordinal").alias("a")), "a", "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _gone(reps: DataFrame, groups: DataFrame, cutoff: int, leaders: int) -> DataFrame:
    """Ordinals that an earlier kept row makes redundant."""
    gone = []
    while True:
        groups = cut_lineage(_live(groups))
        if (groups.agg(F.max("rows")).first()[0] or 0) <= leaders:
            # Every row is a leader of all its groups: nothing has to wait.
            return _union(gone + _settle(_fragment_pairs(groups, groups, reps, cutoff), None)[0] or [reps.select("ordinal").limit(0)])
        heads = cut_lineage(first_per(groups, ["key"], ["ordinal"], leaders))
        waiting = cut_lineage(
            groups.join(heads.select("key", "ordinal"), ["key", "ordinal"], "left_anti")
            .select("ordinal").distinct()
        )
        out, undecided = _settle(_fragment_pairs(heads, groups, reps, cutoff), waiting)
        gone += out
        unsure = waiting.unionByName(undecided.select(F.col("b").alias("ordinal"))).distinct()
        for part in out:
            unsure = unsure.join(part, "ordinal", "left_anti")
        groups = cut_lineage(groups.join(unsure, "ordinal", "left_semi"))
        if groups.isEmpty():
            break
        leaders *= GROWTH
    return _union(gone) if gone else reps.select("ordinal").limit(0)


def _title_pairs(reps: DataFrame, cutoff: int) -> DataFrame | None:
    """Similar pairs of titles whatever their price, each way round: title ``t``
    and the numbers ``id`` of itself and ``other`` of the one it resembles. None
    where the titles, or these pairs, are not few."""
    size = reps.agg(F.count("*").alias("rows"), F.count_distinct("t").alias("titles")).first()
    if size["titles"] > FEW_TITLES or size["rows"] < REPEATED * size["titles"]:
        return None
    titles = cut_lineage(reps.groupBy("t", "n", "mask").agg(F.min("ordinal").alias("ordinal")).coalesce(8))
    near = titles.alias("b").join(F.broadcast(titles.alias("a")), _near(cutoff))
    both = near.select(*[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in ("t", "ordinal")])
    found = cut_lineage(with_similarity(both, "t_a", "t_b", cutoff))
    if found.count() > FEW_PAIRS:
        return None
    return found.selectExpr("t_a as t", "ordinal_a as id", "ordinal_b as other").unionByName(
        found.selectExpr("t_b as t", "ordinal_b as id", "ordinal_a as other")
    )


def _gone_by_price(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ordinals that an earlier kept row makes redundant: the rows of a price in
    order, each against the titles kept so far."""
    rivals = pairs.groupBy("t", "id").agg(F.collect_list("other").alias("near"))
    placed = reps.join(F.broadcast(rivals), "t").select("p", F.struct("ordinal", "id", "near").alias("row"))
    none = "cast(array() as array<bigint>)"
    walk = (
        f"aggregate(array_sort(rows), named_struct('kept', {none}, 'gone', {none}), (s, r) -> if(arrays_overlap(s.kept, r.near), "
        "named_struct('kept', s.kept, 'gone', concat(s.gone, array(r.ordinal))), "
        "named_struct('kept', concat(s.kept, array(r.id)), 'gone', s.gone))).gone"
    )
    return placed.groupBy("p").agg(F.collect_list("row").alias("rows")).select(F.explode(F.expr(walk)).alias("ordinal"))


def _reps(df: DataFrame, cutoff: int) -> DataFrame:
    if not 67 <= cutoff < 100:
        raise ValueError("cutoff is from 67 to 99")
    return cut_lineage(_distinct_titles(check_unique(df)))


def _prepare(df: DataFrame, cutoff: int):
    reps = _reps(df, cutoff)
    return reps, cut_lineage(_fragment_groups(reps, cutoff))


def similar_pairs(
    df: DataFrame, cutoff: int = fv.SIMILAR_CUTOFF, leaders: int = GROUP_LEADERS
) -> DataFrame:
    """Each row that goes as a near duplicate, ``b``, with the first kept row
    it resembles, ``a``. Equal titles at one price count as one row."""
    reps, groups = _prepare(df, cutoff)
    gone = cut_lineage(_gone(reps, groups, cutoff, leaders))
    live = _live(groups)
    kept, dropped = live.join(gone, "ordinal", "left_anti"), live.join(gone, "ordinal", "left_semi")
    return _fragment_pairs(kept, dropped, reps, cutoff).groupBy("b").agg(F.min("a").alias("a"))


def dedup_similar(
    df: DataFrame, mode: str = "fuzzy", cutoff: int = fv.SIMILAR_CUTOFF, leaders: int = GROUP_LEADERS
) -> DataFrame:
    """Keep the rows that resemble no earlier kept row. ``exact`` mode takes
    only equal titles for similar. Ordinals have to be unique."""
    if mode == "exact":
        keyed = df.withColumn("_t", F.coalesce("title", F.lit("")))
        return first_per(keyed, ["_t", "raw_price"], ["ordinal"]).drop("_t")
    if mode != "fuzzy":
        raise ValueError("mode is fuzzy or exact")
    reps = _reps(df, cutoff)
    pairs = _title_pairs(reps, cutoff)
    if pairs is not None:
        gone = _gone_by_price(reps, pairs)
    else:
        gone = _gone(reps, cut_lineage(_fragment_groups(reps, cutoff)), cutoff, leaders)
    kept = reps.join(gone, "ordinal", "left_anti").select("ordinal")
    return df.join(kept, "ordinal", "left_semi")
