"""Which contacts and locations are next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardfile.functions import scalars as S
from cardfile.operators.clean import best_contact_email
from cardfile.sources.tables import processed_emails

#: Ranges of the order within which rows are counted, so that no sort is global; about as many rows in each.
RANGES = 128


def numbered(df: DataFrame, order: str, into: str = "nth") -> DataFrame:
    """df with each row's place, from 0, by a numeric column that tells rows apart.

    Rows are counted per range of the order, between quantiles of it; a range's
    start is the sum of the counts before it.
    """
    bounds = df.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_bounds"))
    part = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col(order))), F.lit(0)).alias("_part")
    dealt = df.join(F.broadcast(bounds)).select(*df.columns, part)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_own")).alias(into))


def sliced(df: DataFrame, order: str, skip: int = 0, limit: int = 0) -> DataFrame:
    """Without the first `skip` rows, and at most `limit` (0: all)."""
    nth = numbered(df, order, "_nth")
    return nth.where((F.col("_nth") >= skip) & ((F.col("_nth") < skip + limit) if limit else F.lit(True))).drop("_nth")


def chunk(df: DataFrame, order: str, k: int, n: int) -> DataFrame:
    """Every n-th row from the k-th, 1 <= k <= n."""
    if not 1 <= k <= n:
        raise ValueError(f"chunk {k} of {n}")
    return numbered(df, order, "_nth").where(F.col("_nth") % n == k - 1).drop("_nth")


def exclude_existing(cities: DataFrame, outputs: DataFrame) -> DataFrame:
    return cities.join(outputs.select("location").distinct(), cities["city"] == F.col("location"), "left_anti")


def plan_locations(cities: DataFrame, outputs: DataFrame, skip: int = 0, limit: int = 0, k: int = 1, n: int = 1) -> DataFrame:
    """Cities sliced, then chunked, then without those that have output."""
    return exclude_existing(chunk(sliced(cities, "ord", skip, limit), "ord", k, n), outputs)


def exclude_processed(contacts: DataFrame, log: DataFrame) -> DataFrame:
    done = processed_emails(log).withColumnRenamed("email", "_done")
    return contacts.join(done, F.lower(S.trimmed("email")) == F.col("_done"), "left_anti")


def select_contacts(contacts: DataFrame, log: DataFrame, skip: int = 0, limit: int = 0, min_email_length: int = 6, only_with_name: bool = False) -> DataFrame:
    """Contacts with an address, sliced, and then without those in the log."""
    rows = contacts.withColumn("email", best_contact_email("contact_email", S.split_emails("all_emails_found", ";"))).where(F.length("email") >= min_email_length)
    if only_with_name:
        rows = rows.where("contact_person <> ''")
    return exclude_processed(sliced(rows, "ord", skip, limit), log)


def preview(df: DataFrame, order: str, n: int = 10, width: int = 40) -> DataFrame:
    """The first n rows, long text cut with two dots; a report for reading."""
    cells = [F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width - 2)), F.lit(".."))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    return df.orderBy(order).limit(n).select(*cells)
