"""URL filters by dated lists: which entry held when a page was fetched.

Entries become validity intervals, one from each entry to the next of the same
pattern; every capture meets the entries that were active at its fetch time, and
the most specific of them decides. Only DataFrame operations.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbside.session import cut_lineage

#: Actions by strength: of several entries of one pattern and time the last wins.
ACTIONS = ("remove", "allow", "block")
#: Decision on captures that no active entry concerns.
DEFAULT = "allow"


def host_of(url):
    """Host of an absolute URL in lower case, without user and port; '' else."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    return F.coalesce(host, F.lit(""))


def path_of(url):
    """Path of an absolute URL without query and fragment, from its slash on."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def patterns_of(url):
    """All patterns that concern a URL: its host and each parent domain, and
    the host with each leading part of the path."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(
        F.size(steps) > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps))),
            lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def _month(time):
    return F.year(time) * 12 + F.month(time)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, active_from, active_to) of the entries (pattern,
    action, dated): from each entry to the next of its pattern, open-ended with
    a null; ``remove`` ends an entry and is none itself. Hosts are in lower
    case, paths are kept as they are."""
    strength = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    usable = entries.where("pattern is not null and dated is not null").where(F.col("action").isin(*ACTIONS))
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.expr("substr(pattern, length(substring_index(pattern, '/', 1)) + 1)"))
    one = usable.groupBy(pattern.alias("pattern"), "dated").agg(F.max(strength).alias("strength"))
    following = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    spans = one.select("pattern", "strength", F.col("dated").alias("active_from"), following.alias("active_to"))
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("strength").cast("int"))
    return spans.where("strength > 1").select("pattern", action.alias("action"), "active_from", "active_to")


def decide(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with decision, pattern and listed_since beside each row.

    ``captures``: url, fetched_at and any other columns (those named decision,
    pattern or listed_since are replaced). Of the entries active at fetched_at,
    from active_from on and before active_to, that with the longest pattern
    decides. Rows without one, or with a null in url or fetched_at, get DEFAULT
    and nulls; no row goes or doubles. Entries with a null are left out.

    The join is on pattern and calendar month, so that a pattern with a long
    history does not meet all captures of its host; distinct (url, fetched_at)
    are decided once. Hot hosts are a skewed key of a plain join of stored
    tables, which adaptive execution splits.
    """
    captures = captures.drop("decision", "pattern", "listed_since")
    asked = captures.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct()
    keys = asked.select(
        "url", "fetched_at", _month(F.col("fetched_at")).alias("month"), F.explode(patterns_of(F.col("url"))).alias("pattern")
    )
    last = asked.agg(F.max("fetched_at")).first()[0]
    spans = intervals(entries)
    if last is not None:
        spans = spans.where(F.col("active_from") <= F.lit(last))
        until = F.least(F.coalesce("active_to", F.lit(last)), F.lit(last))
    else:
        until = F.col("active_from")
    by_month = cut_lineage(
        spans.select("*", F.explode(F.sequence(_month(F.col("active_from")), _month(until))).alias("month"))
    )
    active = keys.join(by_month, ["pattern", "month"]).where(
        "fetched_at >= active_from and (active_to is null or fetched_at < active_to)"
    )
    best = F.max(F.struct(F.length("pattern").alias("size"), "pattern", "action", "active_from"))
    chosen = cut_lineage(
        active.groupBy("url", "fetched_at").agg(best.alias("b")).select(
            "url", "fetched_at", F.col("b.action").alias("decision"), F.col("b.pattern").alias("pattern"),
            F.col("b.active_from").alias("listed_since"),
        )
    )
    joined = captures.join(chosen, ["url", "fetched_at"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in captures.columns], F.coalesce("decision", F.lit(DEFAULT)).alias("decision"),
        "pattern", "listed_since",
    )
