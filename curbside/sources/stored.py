"""Readers for stored pages, payloads and post files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside import fixed_values as fv
from curbside import schema


def read_pages(spark: SparkSession, path: str, source: str = fv.DEFAULT_SOURCE) -> DataFrame:
    """Stored pages as a Parquet table. ``source`` labels pages without one."""
    pages = spark.read.schema(schema.PAGES).parquet(path)
    return pages.withColumn("source", F.coalesce("source", F.lit(source)))


def read_page_files(
    spark: SparkSession, path: str, kind: str, location: str, source: str = fv.DEFAULT_SOURCE
) -> DataFrame:
    """A folder of HTML files, one page per file; the file is its url."""
    files = spark.read.text(path, wholetext=True).withColumn("url", F.col("_metadata.file_path"))
    given = {
        "page_id": F.xxhash64("url"),
        "kind": F.lit(kind),
        "location": F.lit(location),
        "source": F.lit(source),
        "keyword_idx": F.lit(0),
        "offset": F.lit(0),
        "fetched_at": F.col("_metadata.file_modification_time"),
        "html": F.col("value"),
    }
    shaped = files.withColumns(given)
    return shaped.select(*[F.col(f.name).cast(f.dataType) for f in schema.PAGES])


def read_payload_table(spark: SparkSession, path: str) -> DataFrame:
    """Payload texts that ``write_payloads`` wrote to ``path``, as
    ``read_payloads`` gives them."""
    return _payload_texts(spark.read.schema("name string, value string").parquet(path), "name")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON payload texts in files ``location.json`` or ``location.number.json``,
    or in folders ``name=location.number`` with one file each; the number orders
    the texts of a location, without one it is 0. Every file is listed by the
    driver: many texts are better kept in a table (``read_payload_table``)."""
    files = spark.read.text(path, wholetext=True)
    return _payload_texts(files, "name" if "name" in files.columns else "_metadata.file_name")


def _payload_texts(files: DataFrame, name: str) -> DataFrame:
    number = F.regexp_extract(name, r"\A[^.]*\.(\d+)(?:\.|\z)", 1).try_cast("bigint")
    return files.select(
        F.regexp_extract(name, r"\A([^.]*)", 1).alias("location_key"),
        F.coalesce(number, F.lit(0)).alias("payload_no"),
        F.col("value").alias("body"),
    )


def _read_rows(spark, path, as_lines, name, lines, document) -> DataFrame:
    if as_lines:
        return spark.read.schema(lines).json(f"{path}/{name}")
    whole = spark.read.schema(document).json(path, multiLine=True)
    rows = whole.select(F.posexplode(name).alias("ordinal", "_r"))
    return rows.select("_r.*", F.col("ordinal").cast("bigint").alias("ordinal"))


def read_posts(spark: SparkSession, path: str, as_lines: bool = True) -> DataFrame:
    """Posts that ``write_posts`` wrote to ``path``, with their ``ordinal``:
    the JSON Lines, or with ``as_lines=False`` the one document, which a single
    task reads. A document without posts gives no rows; a missing path is an
    error."""
    lines = schema.with_ordinal(schema.POST)
    return _read_rows(spark, path, as_lines, "posts", lines, schema.POSTS_FILE)


def read_posts_by(spark: SparkSession, path: str, by: str, kind: str = "long") -> DataFrame:
    """Posts that ``write_posts`` wrote in one document for each value of
    ``by``, a ``kind``, with it and their ``ordinal`` in the document."""
    documents = spark.read.schema(T.StructType().add(by, kind).add(schema.POSTS_FILE["posts"])).json(path)
    rows = documents.select(by, F.posexplode("posts").alias("ordinal", "_r"))
    return rows.select(by, "_r.*", F.col("ordinal").cast("bigint").alias("ordinal"))


def read_actions(spark: SparkSession, path: str, as_lines: bool = True) -> DataFrame:
    """Actions that ``write_action_ledger`` wrote to ``path``. Lines are in
    the order of their ``timestamp``; a document's have an ``ordinal``."""
    return _read_rows(spark, path, as_lines, "actions", schema.ACTION, schema.ACTION_FILE)
