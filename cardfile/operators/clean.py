"""Cleaning of contact rows: which addresses stay, and which is the contact's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardfile.functions import scalars as S


def collect_row_emails(*cells: str) -> Column:
    """Addresses of the cells in order, distinct by lower case, first spelling kept."""
    return S.distinct_emails(F.flatten(F.array(*[S.split_emails(c) for c in cells])))


def best_contact_email(current: Column | str, emails: Column | str) -> Column:
    """The current address if valid, else the first valid one of the list, else ''."""
    current = S.clean_value(current)
    return F.coalesce(F.when(S.is_valid_target_email(current), current), F.get(F.filter(emails, lambda e: S.is_valid_target_email(e)), F.lit(0)), F.lit(""))


def first_personal_email(emails: Column | str) -> Column:
    """The first address that is no role's, else the first."""
    personal = F.filter(emails, lambda e: ~F.lower(S.email_local(e)).isin(*S.C.GENERIC_LOCALS))
    return F.coalesce(F.get(personal, F.lit(0)), F.get(emails, F.lit(0)))


def judged(df: DataFrame, strict: bool = False, cells: tuple[str, ...] = ("contact_email", "all_emails_found")) -> DataFrame:
    """df with emails (all), kept and removed, as arrays.

    Rows are dealt by their cells first, as a file of few MB is work for many
    tasks. Each address is judged once: what a row's generator returns is not
    computed anew for each column or condition that uses it.
    """
    told = F.transform(collect_row_emails(*cells), lambda e: F.struct(e.alias("email"), S.is_valid_target_email(e, strict).alias("valid")))
    found = df.repartition(*cells).select("*", F.explode(F.array(told)).alias("_told"))
    emails = lambda part: F.transform(part, lambda x: x["email"])
    found = found.withColumn("emails", emails("_told")).withColumn("kept", emails(F.filter("_told", lambda x: x["valid"])))
    return found.withColumn("removed", emails(F.filter("_told", lambda x: ~x["valid"]))).drop("_told")


def clean_contacts(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with a surviving address, their cells rebuilt from the survivors; the contact's is re-picked among them."""
    rows = judged(df, strict).where(F.size("kept") > 0)
    current = S.clean_value("contact_email")
    again = F.coalesce(F.get(F.filter("kept", lambda e: F.lower(e) == F.lower(current)), F.lit(0)), F.get("kept", F.lit(0)))
    return rows.withColumn("contact_email", again).withColumn("all_emails_found", S.join_emails("kept")).select(*df.columns)


def cleaning_summary(df: DataFrame, group: str, strict: bool = False) -> DataFrame:
    """Per group and in total (null): rows kept and dropped, addresses removed from kept rows and from all."""
    rows = judged(df, strict).withColumn("stays", F.size("kept") > 0)
    return rows.rollup(group).agg(
        F.count_if("stays").alias("rows_kept"), F.count_if(~F.col("stays")).alias("rows_dropped"),
        F.coalesce(F.sum(F.when(F.col("stays"), F.size("removed"))), F.lit(0)).alias("removed_from_kept"), F.sum(F.size("removed")).alias("removed"),
    )


def removed_detail(df: DataFrame, strict: bool = False) -> DataFrame:
    return judged(df, strict).select("company_name", F.posexplode("removed").alias("pos", "email"))
