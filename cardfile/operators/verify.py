"""Deliverability of addresses by stored DNS and mailbox answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardfile.functions import scalars as S
from cardfile.operators.clean import best_contact_email

MX, A, AAAA = 15, 1, 28


def domain_records(dns: DataFrame) -> DataFrame:
    """Per domain: has_mx, mx_host (lowest preference), has_addr; null where the lookups failed.

    status 0 answers, 3 says there is none, others failed. One aggregation with
    partial results, so a provider with many answers is no large task.
    """
    rows = dns.withColumn("mx", F.when((F.col("rtype") == MX) & (F.col("type") == MX), S.parse_mx("data")))
    known = F.col("status").isin(0, 3)
    got = lambda r: F.max((F.col("rtype") == r) & (F.col("type") == r) & (F.col("status") == 0))
    failed = lambda r: F.max((F.col("rtype") == r) & ~known)
    asked = lambda r: F.max((F.col("rtype") == r) & known)
    sums = rows.groupBy("domain").agg(
        F.min("mx").alias("best"), asked(MX).alias("mx_known"), got(A).alias("a"), got(AAAA).alias("aaaa"), asked(A).alias("a_known"), asked(AAAA).alias("aaaa_known"), failed(A).alias("a_failed"), failed(AAAA).alias("aaaa_failed"),
    )
    has_addr = F.when(F.col("a") | F.col("aaaa"), True).when(F.col("a_known") & F.col("aaaa_known") & ~F.col("a_failed") & ~F.col("aaaa_failed"), False)
    return sums.select("domain", F.when(F.col("best").isNotNull(), True).when(F.col("mx_known"), False).alias("has_mx"), F.col("best.host").alias("mx_host"), has_addr.alias("has_addr"))


def verified(emails: DataFrame, dns: DataFrame, mailbox: DataFrame, mx_only: bool = False) -> DataFrame:
    """(email, status, reason) of each distinct lower-case address."""
    once = emails.select(F.lower(S.trimmed("email")).alias("email")).where("email <> ''").distinct().withColumn("domain", S.email_domain("email"))
    answers = mailbox.select(F.lower("email").alias("email"), "accepted").groupBy("email").agg(F.max("accepted").alias("accepted"))
    rows = once.join(domain_records(dns), "domain", "left").join(answers, "email", "left")
    said = S.verify_status(S.is_valid_target_email("email", strict=True), F.col("has_mx"), F.col("mx_host"), F.col("has_addr"), F.col("domain"), F.col("accepted"), mx_only)
    return rows.select("email", said.alias("said")).select("email", "said.status", "said.reason")


def verify_contacts(contacts: DataFrame, dns: DataFrame, mailbox: DataFrame, mx_only: bool = False, strict: bool = False) -> DataFrame:
    """contacts with their picked address, status, reason and keep; rows without an address are left out."""
    picked = contacts.withColumn("email", best_contact_email("contact_email", S.split_emails("all_emails_found"))).where("email <> ''")
    found = verified(picked, dns, mailbox, mx_only).withColumnRenamed("email", "_email")
    rows = picked.join(found, F.lower("email") == F.col("_email"), "left").drop("_email")
    rows = rows.withColumn("status", F.coalesce("status", F.lit("unknown"))).withColumn("reason", F.coalesce("reason", F.lit("not verified")))
    return rows.withColumn("keep", (F.col("status") == "valid") | ((F.col("status") == "unknown") & ~F.lit(strict)))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))
