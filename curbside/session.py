"""Session settings and the shared folder for intermediate tables."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages are large texts: small batches keep a batch within memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Limits per key up to this size are applied before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "curbside", master: str | None = None, **extra) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    The number of shuffle partitions stays with the cluster's own settings;
    adaptive execution merges the small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def compile_methods(spark: SparkSession) -> None:
    """The JVM leaves methods above 8,000 bytes of code to its interpreter. A
    stage that would be one such method runs operator by operator instead, in
    methods short enough to be compiled."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables that all executors see.

    Taken from ``spark.checkpoint.dir``. A temporary folder is used only in
    local mode with that setting absent, where it is visible to every task.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="curbside-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``; survives the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


_SHIPPED = "curbside.package.shipped"


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per session: they load
    its functions by name and may have no copy of their own."""
    if spark.conf.get(_SHIPPED, None):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="curbside-package-")) / "curbside_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set(_SHIPPED, "true")


def once(df: DataFrame, **columns) -> DataFrame:
    """Add columns that are evaluated once per row. They come from a generator,
    which the optimizer neither inlines nor repeats in later filters."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
