"""Writers for curated tables."""

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside import schema
from curbside.operators.clean import as_listing_schema
from curbside.session import cut_lineage

log = logging.getLogger("curbside.sinks")


def _plain(c: Column) -> Column:
    """A double in plain digits, as in 10000000.0."""
    return F.call_function("format_number", c, F.lit("0.0###############"))


def write_csv(df: DataFrame, path: str, stored: bool = False) -> bool:
    """Header and rows, UTF-8, quotes doubled, null as an empty cell. An empty
    table writes nothing. What ``df`` is made by runs once: its rows are stored
    in between, unless they are ``stored`` already."""
    df = df if stored else cut_lineage(df)
    if df.isEmpty():
        log.warning("no rows to export to CSV")
        return False
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    text = df.withColumns({c: _plain(F.col(c)) for c in doubles})
    text.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="",
                                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return True


def write_json(df: DataFrame, path: str, stored: bool = False) -> bool:
    """JSON Lines with nulls kept and non-ASCII escaped. An empty table writes
    nothing. Runs its input once, as ``write_csv``."""
    df = df if stored else cut_lineage(df)
    if df.isEmpty():
        log.warning("no rows to export to JSON")
        return False
    (df.write.mode("overwrite").option("ignoreNullFields", "false")
       .option("writeNonAsciiCharacterAsCodePoint", "true").json(path))
    return True


def export_all(listings: DataFrame, folder: str, formats: str = "both") -> None:
    """The listings as Parquet by location, and from that as CSV and JSON, so
    that the job behind them runs once."""
    native = f"{folder}/listings.parquet"
    as_listing_schema(listings).write.mode("overwrite").partitionBy("location").parquet(native)
    stored = as_listing_schema(
        listings.sparkSession.read.schema(as_listing_schema(listings).schema).parquet(native)
    )
    if formats in ("both", "csv"):
        write_csv(stored, f"{folder}/listings.csv", stored=True)
    if formats in ("both", "json"):
        write_json(stored, f"{folder}/listings.json", stored=True)


def _write_with_metadata(
    rows: DataFrame, name: str, metadata: dict[str, Column], path: str, order_by: list[str],
    columns: list[str], document_limit: int | None, document_by: str | None = None,
) -> None:
    """Rows as JSON Lines next to a one-row table of metadata, which are
    aggregates of what was written or literals: the input runs once. Each line
    keeps its ``order_by`` columns, so that the order is there on reading.

    With ``document_limit``, rows and metadata form one document instead. One
    task then holds all rows, which is why the caller states how many there may
    be; more are refused. With ``document_by``, each value of that column has a
    document, a line, of its own, next to the value.
    """
    entry = F.struct(F.struct(*order_by).alias("at"), F.struct(*columns).alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["row"])
    if document_by is not None:
        grouped = rows.groupBy(document_by).agg(*[c.alias(k) for k, c in metadata.items()], listed.alias(name))
        documents = grouped.select(document_by, F.struct(*metadata).alias("metadata"), name)
        documents.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return
    if document_limit is None:
        place = [c for c in order_by if c not in columns]
        rows.select(*columns, *place).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
        kind = rows.select(*columns, *place).schema
        written = rows.sparkSession.read.schema(kind).json(f"{path}/{name}")
        written.agg(*[c.alias(k) for k, c in metadata.items()]).write.mode("overwrite").json(f"{path}/metadata")
        return
    rows = cut_lineage(rows)
    if rows.limit(document_limit + 1).count() > document_limit:
        raise ValueError(f"more than {document_limit} rows: write JSON Lines instead")
    document = rows.agg(*[c.alias(k) for k, c in metadata.items()], listed.alias(name)).select(
        F.struct(*metadata).alias("metadata"), name
    )
    document.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_posts(posts: DataFrame, path: str, source: str, as_of: str, order_by=("ordinal",),
                document_limit: int | None = None, document_by: str | None = None) -> None:
    """Posts with their metadata, also when there are none, in the order of
    ``order_by``; one document for up to ``document_limit`` posts, if given, or one
    for each value of ``document_by``, which no task holds more than one of."""
    metadata = {
        "scraped_at": F.lit(as_of),
        "total_posts": F.count("*"),
        "source": F.lit(source),
    }
    _write_with_metadata(posts, "posts", metadata, path, list(order_by), schema.POST.fieldNames(), document_limit, document_by)


def write_action_ledger(actions: DataFrame, path: str, session_start: str, daily_limit: int,
                        order_by=("timestamp",), document_limit: int | None = None) -> None:
    """Actions with their metadata; the total counts the successful ones."""
    metadata = {
        "session_start": F.lit(session_start),
        "total_actions": F.count_if(F.col("success")),
        "daily_limit": F.lit(daily_limit),
    }
    _write_with_metadata(
        actions, "actions", metadata, path, list(order_by), schema.ACTION.fieldNames(), document_limit
    )


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Payload texts (``location_key``, ``payload_no``, ``body``) as a Parquet
    table of ``location.number`` and text, whose files grow with the texts' size
    and not with their number."""
    payloads.selectExpr("concat(location_key, '.', payload_no) as name", "body as value").write.parquet(path)
