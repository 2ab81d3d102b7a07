"""Keyed tables, versions, the concept ledger and what is rolled up from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replace_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of a key wins; ``order`` sorts the winner first and ends with a tie-break."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


#: The first row of a key wins: the same, with the other order.
insert_or_ignore = replace_by_key


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def coalesce_update(target: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the target that are null take the patch's value."""
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(p, key, "left")
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in target.columns])


def latest_version(mentions: DataFrame, version: str = "lexicon_version") -> DataFrame:
    """C4: the rows of the greatest version."""
    top = mentions.agg(F.max(version).alias("__v"))
    return mentions.join(F.broadcast(top), F.col(version) == F.col("__v")).drop("__v")


def insert_version(ledger: DataFrame, rows: DataFrame, version: int, key: list[str]) -> DataFrame:
    """Adds the rows of a version that it doesn't have yet; other versions stay."""
    new = rows.withColumn("lexicon_version", F.lit(version)).dropDuplicates([*key, "lexicon_version"])
    return ledger.unionByName(new.join(ledger, [*key, "lexicon_version"], "left_anti").select(*ledger.columns))


def load_seed(versions: DataFrame, concepts: DataFrame, aliases: DataFrame, version: int, note: str, seed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C11: a lexicon version (replacing one of its number), and the concepts and aliases of ``seed`` that are new with it."""
    n = seed.select("concept_id").distinct().agg(F.count("*").alias("concept_count"))
    row = n.select(F.lit(version).alias("version"), F.lit(note).alias("note"), F.col("concept_count"))
    out = upsert(versions, row.select(*versions.columns), ["version"])
    new = seed.select("concept_id", "canonical_name").dropDuplicates(["concept_id"]).join(concepts, "concept_id", "left_anti").withColumn("first_lexicon_version", F.lit(version))
    more = seed.select("concept_id", "pattern").distinct().join(aliases, ["concept_id", "pattern"], "left_anti").withColumn("added_version", F.lit(version))
    return out, concepts.unionByName(new.select(*concepts.columns)), aliases.unionByName(more.select(*aliases.columns))


def patterns_of(aliases: DataFrame, version: int) -> DataFrame:
    """The aliases that a version knows."""
    return aliases.where(F.col("added_version") <= version)


def check_patterns(aliases: list[tuple[str, str]]) -> None:
    """An alias that doesn't compile stops the run."""
    import re

    for concept, pattern in aliases:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"alias {pattern!r} of {concept}: {e}") from e


def match_aliases(texts: DataFrame, aliases: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """(row, concept, match) for the first case-insensitive match of each concept's aliases, in one scan.

    The patterns are data of the ledger, some hundred at most. Each becomes a literal expression, compiled once; word
    characters and borders are those of all scripts.
    """
    check_patterns(aliases)
    by_concept: dict[str, list[str]] = {}
    for concept, pattern in aliases:
        by_concept.setdefault(concept, []).append(pattern)
    found = [F.struct(F.lit(c).alias("concept"), F.regexp_extract(text, "(?iU)(" + "|".join(f"(?:{p})" for p in ps) + ")", 1).alias("match")) for c, ps in by_concept.items()]
    return texts.withColumn("__m", F.explode(F.filter(F.array(*found), lambda x: x["match"] != ""))).select(*[c for c in texts.columns if c != text], F.col("__m.concept").alias("concept"), F.col("__m.match").alias("match_text"))


def paper_rollup(rows: DataFrame) -> DataFrame:
    """Of each paper first and last day, distinct days, greatest importance, all tags."""
    base = rows.groupBy("paper").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count_distinct("day").alias("seen_count"), F.max("importance").alias("importance_max"))
    tags = rows.select("paper", F.explode("tags").alias("tag")).groupBy("paper").agg(F.collect_set("tag").alias("tags"))
    return base.join(tags, "paper", "left")


def model_index(facts: DataFrame, k: int = 3) -> DataFrame:
    """Of each model the latest day, distinct articles, and its k most frequent facts, ties by first sight."""
    base = facts.groupBy("model").agg(F.to_date(F.max("day")).alias("latest_seen"), F.count_distinct("l_orderkey").alias("articles"))
    n = facts.groupBy("model", "benchmark").agg(F.count("*").alias("n"), F.min(F.struct("day", "l_orderkey", "l_linenumber", "l_partkey")).alias("first"))
    ranked = n.withColumn("k", F.row_number().over(Window.partitionBy("model").orderBy(F.col("n").desc(), "first"))).where(F.col("k") <= k)
    top = ranked.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "benchmark"))), lambda x: x["benchmark"]), ",").alias("top"))
    return base.join(top, "model")


def staleness(status: DataFrame, as_of: Column, most_lag: int = 1, most_hours: int = 30) -> DataFrame:
    """Reasons of each part: missing, lag in days, age in hours."""
    lag = F.datediff(as_of, F.col("latest_day"))
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("last_run")) / 3600
    reasons = F.array(F.when(F.col("latest_day").isNull(), "missing"), F.when(lag > most_lag, "lag"), F.when(hours > most_hours, "age"))
    return status.withColumn("reasons", F.array_join(F.array_compact(reasons), ","))


def integrity(papers: DataFrame, mentions: DataFrame) -> DataFrame:
    """(rule, key) of rows that break a rule: malformed ids, mentions without a paper."""
    bad = papers.where(~F.col("paper_id").rlike(r"^\d{4}\.\d{4,5}$")).select(F.lit("malformed_id").alias("rule"), F.col("paper_id").alias("key"))
    orphan = mentions.join(papers, "paper_id", "left_anti").select(F.lit("orphan_mention").alias("rule"), F.col("paper_id").alias("key"))
    return bad.unionByName(orphan)


def schema_drift(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose version isn't the expected one; a warning, not a failure."""
    e = expected.withColumnRenamed("schema_version", "expected")
    return manifest.join(e, "file", "left").where(~F.col("schema_version").eqNullSafe(F.col("expected"))).select("file", "schema_version", "expected")


def versions(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Of each expected file its version, the one that the manifest has (null: none) and whether they agree."""
    m = manifest.select("file", F.col("schema_version").alias("got"))
    return expected.select("file", F.col("schema_version").alias("expected")).join(m, "file", "left").withColumn("ok", F.col("got").eqNullSafe(F.col("expected")))


def frontier(parts: DataFrame, newest: DataFrame) -> DataFrame:
    """(part, newest, last_run) with its lag in days behind the one day of ``newest`` (as_of)."""
    return parts.crossJoin(F.broadcast(newest)).select("part", "newest", "last_run", F.datediff("as_of", "newest").cast("long").alias("lag"))


def export_lexicon(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as JSON lines, nulls included."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{root}/{name}")


def import_lexicon(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], root: str) -> dict[str, DataFrame]:
    """Of each (table, keys) its rows, and the exported ones whose key it doesn't have."""
    out = {}
    for name, (own, keys) in tables.items():
        more = spark.read.schema(own.schema).json(f"{root}/{name}").dropDuplicates(keys)
        out[name] = own.unionByName(more.join(own.select(*keys), keys, "left_anti").select(*own.columns))
    return out


class LeakError(ValueError):
    pass


def guard_terms(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """``df`` if none of its texts holds a term; else LeakError before anything is written."""
    from lodestream.functions.text import has_term

    bad = F.lit(False)
    for t in terms:
        bad = bad | has_term(F.col(text), F.lit(t))
    if df.where(bad).limit(1).count():
        raise LeakError("a term that must not be published is in the export")
    return df
