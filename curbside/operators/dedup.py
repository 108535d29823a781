"""First-seen-wins duplicates by key. Order is the ``ordinal`` column."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key.

    Planned as a window group limit: every task keeps at most ``n`` rows per
    key before the shuffle, so a key with most of the rows stays small.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= n).drop("_rn")


def dedup_url(df: DataFrame, order=("ordinal",)) -> DataFrame:
    """Drop rows without a url, then keep the first row of each url."""
    return first_per(df.where("url is not null and url <> ''"), ["url"], list(order))


def dedup_in_location(df: DataFrame, order=("keyword_idx", "offset", "position")) -> DataFrame:
    """Keep the first row of each url within its location."""
    return first_per(df, ["location", "url"], list(order))


def dedup_posts(df: DataFrame, order=("snapshot_no", "position"), within=()) -> DataFrame:
    """Keep the first row of each post id (per feed, where feeds are given)."""
    return first_per(df, [*within, "id"], list(order))


def first_seen(df: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """All rows with ``is_duplicate``: an earlier row has the same key.

    The first position of a key is an aggregate with partial results per task;
    the join back can be split where a key is frequent.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    return df.join(first, df[key].eqNullSafe(first["_key"])).select(
        df["*"], (F.col(order) > F.col("_first")).alias("is_duplicate")
    )


def not_yet_published(df: DataFrame, published: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key the published table does not have."""
    return df.join(published.select(key), key, "left_anti")
