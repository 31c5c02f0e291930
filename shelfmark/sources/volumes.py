"""Mounted devices from the reports of the operating system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import shared_dir

_TEXTS = ("name", "uuid", "mountpoint", "fstype")

# Where a volume's text names its mount point.
MOUNT_PATTERN = r"\(([^)]+)\)"
WINDOWS_MOUNT_PATTERN = r"(.*)\s+(\([^\)]+\))"


def _kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def _field(name: str) -> Column:
    return F.variant_get("node", f"$.{name}", "variant")


def block_devices(reports: DataFrame, column: str = "report") -> DataFrame:
    """Devices in the JSON reports of block devices, at whatever depth and under whatever key they stand.

    A device is an object with texts ``name``, ``uuid``, ``mountpoint`` and ``fstype`` and a ``label`` that is a text or null.
    Reports are parsed once; then one level after the other is opened, as long as a level holds objects or lists, so
    there are as many steps as the deepest report has levels.  A null or empty report has no device; one that is no
    JSON is left out here and comes from ``broken_reports``.
    """
    spark = reports.sparkSession
    root = shared_dir(spark, "reports")
    level, depth, parts = reports.select(F.try_parse_json(F.col(column)).alias("node")), 0, []
    container = _kind(F.col("node")).startswith("OBJECT") | _kind(F.col("node")).startswith("ARRAY")
    while True:
        path = f"{root}/level={depth}"
        level.filter(container).write.parquet(path)
        opened = spark.read.schema("node variant").parquet(path)
        if opened.isEmpty():
            break
        parts.append(path)
        inner = opened.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        level, depth = inner.select(F.col("value").alias("node")), depth + 1
    nodes = spark.read.schema("node variant").parquet(*parts) if parts else opened
    whole = F.lit(True)
    for name in _TEXTS:
        whole &= F.coalesce(_kind(_field(name)) == "STRING", F.lit(False))
    label = F.coalesce(_kind(_field("label")).isin("STRING", "VOID"), F.lit(False))
    text = lambda name: F.variant_get("node", f"$.{name}", "string").alias(name)
    found = nodes.filter(_kind(F.col("node")).startswith("OBJECT")).filter(whole & label)
    return found.select(
        text("name"), F.coalesce(F.variant_get("node", "$.label", "string"), F.lit("")).alias("label"), text("uuid"), text("mountpoint"),
        text("fstype"),
    )


def broken_reports(reports: DataFrame, column: str = "report") -> DataFrame:
    """The rows whose report is neither null nor empty and yet no JSON."""
    text = F.col(column)
    return reports.filter((F.trim(text) != "") & F.try_parse_json(text).isNull())


def unique_volumes(stores: DataFrame, pattern: str = MOUNT_PATTERN) -> DataFrame:
    """Volumes (name, text) whose name is not empty and occurs once, as devices; a text without mount point drops."""
    once = (
        stores.filter(F.col("name") != "")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
        .filter("n = 1")
    )
    mount = F.regexp_extract(F.col("text"), pattern, 1)
    return once.filter(F.regexp_like(F.col("text"), F.lit(pattern))).select(
        F.lit("").alias("name"),
        F.col("name").alias("label"),
        F.col("name").alias("uuid"),
        mount.alias("mountpoint"),
        F.lit("").alias("fstype"),
    )


def repeated_volumes(stores: DataFrame) -> DataFrame:
    """Names ``unique_volumes`` leaves out because several volumes carry them."""
    return (
        stores.filter(F.col("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("volumes")).filter("volumes > 1")
    )
