"""Idempotent writers (S18 to S27): partitions replaced, keys upserted, checks before a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.ledger import guard_terms, upsert
from lodestream.session import settle, switch


def replace_partitions(df: DataFrame, path: str, by: str = "day") -> None:
    """The partitions of ``df`` take the place of those at ``path``; others stay. A rerun changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_path(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows at ``path`` with a key of ``df`` go, ``df`` comes. The new table is written beside the old one and takes its place by renames."""
    merged = upsert(spark.read.schema(df.schema).parquet(path), df, keys) if settle(spark, path) else df
    replace_table(merged, path)


def replace_table(df: DataFrame, path: str) -> None:
    """``df``, which may read what is at ``path``, takes its place as one step; a run that fails before leaves the old table."""
    aside = f"{path}.new"
    df.write.mode("overwrite").parquet(aside)
    switch(df.sparkSession, aside, path)


def flatten_members(clusters: DataFrame) -> DataFrame:
    """A row for each member of (cluster_id, representative, members), and whether it is the representative."""
    m = clusters.select("cluster_id", F.col("representative.url").alias("__rep"), F.explode("members").alias("m"))
    return m.select("cluster_id", "m.*", (F.col("m.url") == F.col("__rep")).alias("is_representative"))


def export_tables(tables: dict[str, tuple[DataFrame, list[str]]], root: str, csv: bool = True) -> dict[str, int]:
    """Each table in a fixed order as Parquet, and CSV if all columns are flat; row counts for the manifest."""
    counts = {}
    for name, (df, order) in tables.items():
        sorted_ = df.orderBy(*order)
        sorted_.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
        if csv and all("<" not in t for _, t in df.dtypes):
            sorted_.write.mode("overwrite").option("header", True).csv(f"{root}/{name}.csv")
        counts[name] = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}.parquet").count()
    return counts


def manifest(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """File, bytes, sha256, lines of each file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    lines = F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n"))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), lines.alias("lines"), F.lit(version).alias("schema_version"))


def sync_plan(here: DataFrame, there: DataFrame) -> DataFrame:
    """(file, state) of what has to be copied: files that aren't there, or are with another hash."""
    t = there.select("file", F.col("sha256").alias("__t"))
    both = here.join(t, "file", "left").where(~F.col("sha256").eqNullSafe(F.col("__t")))
    return both.select("file", F.when(F.col("__t").isNull(), "new").otherwise("changed").alias("state"))


def verify_counts(spark: SparkSession, root: str, expected: dict[str, int]) -> None:
    """Stops if a written table doesn't have the rows it should have."""
    for name, n in expected.items():
        found = spark.read.parquet(f"{root}/{name}.parquet").count()
        if found != n:
            raise ValueError(f"{name}: {found} rows instead of {n}")


def retained(days: DataFrame, as_of: str, keep: int = 7) -> DataFrame:
    """Checkpoints of the last ``keep`` days, and Mondays."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("day"))
    return days.where((age < keep) | (F.weekday("day") == 0))


def public_export(df: DataFrame, text: str, forbidden: list[str], path: str) -> None:
    """Nothing is written if a forbidden term is in it."""
    guard_terms(df, text, forbidden).write.mode("overwrite").json(path)
