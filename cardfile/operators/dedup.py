"""First-wins dedup, per-group limits, quotas and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardfile.functions.scalars import trimmed


def first_of_each(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The first row of each key; the order must tell rows apart.

    A minimum of the whole row is pre-aggregated before it is shuffled, so a
    key that holds a third of the rows is no large task.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def dedup_companies(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per name and website, both lower-cased and trimmed."""
    return first_of_each(df, [F.lower(trimmed("company_name")).alias("_k1"), F.lower(trimmed("website")).alias("_k2")], order)


def distinct_elements(df: DataFrame, order: list[str]) -> DataFrame:
    return first_of_each(df, ["type", "id"], order)


def limit_per_group(df: DataFrame, groups: list[str], n: int, order: list[str]) -> DataFrame:
    """At most n rows a group. Spark cuts each group before it is shuffled."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("_nth") <= n).drop("_nth")


def fill_to_quota(chosen: DataFrame, spare: DataFrame, groups: list[str], target: int, host: str, order: list[str]) -> DataFrame:
    """chosen and, per group, spare rows of hosts not yet taken, until target rows; fill tells them apart.

    Hosts are made distinct before rows are ranked, so no group is under-filled.
    """
    taken = chosen.select(*groups, host).distinct()
    fresh = first_of_each(spare.join(taken.hint("merge"), [*groups, host], "left_anti"), [*groups, host], order)
    ranked = fresh.withColumn("_nth", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_nth") <= target)
    have = chosen.groupBy(*groups).agg(F.count("*").alias("_have"))
    added = ranked.join(have, groups, "left").where(F.col("_nth") <= target - F.coalesce("_have", F.lit(0))).drop("_nth", "_have")
    return chosen.withColumn("fill", F.lit(False)).unionByName(added.withColumn("fill", F.lit(True)))


def with_fallback(df: DataFrame, groups: list[str], strict: str, relaxed: str, least: int) -> DataFrame:
    """Rows that are strict, and relaxed ones of groups with fewer than `least` strict rows; layer says which."""
    n = df.groupBy(*groups).agg(F.count_if(strict).alias("_strict"))
    layered = df.join(n, groups).withColumn("layer", F.when(F.col(strict), "strict").when(F.col(relaxed) & (F.col("_strict") < least), "relaxed"))
    return layered.where("layer is not null").drop("_strict")
