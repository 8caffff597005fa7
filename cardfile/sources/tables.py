"""Reading and writing contact lists, pages, places, DNS answers and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardfile.functions import constants as C
from cardfile.functions.scalars import clean_value, trimmed

EMAIL_HEADERS = ("Contact Email", "All Emails Found", "emails")
GEO_ELEMENT = "type string, id long, lat double, lon double, tags map<string,string>"
PLACE_RESULT = "id string, title string, contacts array<struct<www: array<struct<value: string>>, phone: array<struct<value: string>>>>"
DNS_ANSWER = "domain string, rtype int, status int, type int, data string"


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"')


def list_contact_files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """(path, file, header): CSV files whose name does not hold "sent", with their header line.

    A file's first line is that of its first block, which one task reads in
    order; each task keeps the first line it meets of a file, so that is all that is shuffled.
    """
    lines = spark.read.text(folder, pathGlobFilter="*.csv").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    first = lines.where(~F.contains(F.lower("file"), F.lit("sent")) & (F.col("block") == 0)).groupBy("path", "file").agg(F.min_by("value", "n").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", "^\ufeff|\r$", ""))


def has_email_columns(columns: list[str]) -> bool:
    return any(c in columns for c in EMAIL_HEADERS)


def read_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """All contact files of a folder: file, ord, and the columns of every layout.

    Files are read per distinct header, so that columns are never matched by
    position; a layout without any address column is left out. ord tells all
    rows apart and follows their order within a file. Empty values are '', values are trimmed. The headers (a few layouts) and their paths are
    what reaches the driver.
    """
    return _by_layout(spark, list_contact_files(spark, folder))


def read_contact_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """read_contacts of these files."""
    return _by_layout(spark, list_contact_files(spark, paths))


def _by_layout(spark: SparkSession, files: DataFrame) -> DataFrame:
    layouts = files.groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header").collect()
    frames = []
    for layout in layouts:
        rows = _csv(spark).csv(layout["paths"])
        if not has_email_columns(rows.columns):
            continue
        values = [clean_value(F.col(f"`{c}`")).alias(c.strip()) for c in rows.columns]
        frames.append(rows.select(F.col("_metadata.file_name").alias("file"), *values))
    if not frames:
        return spark.createDataFrame([], "file string, ord long, `Contact Email` string")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return every.na.fill("").select("file", F.monotonically_increasing_id().alias("ord"), *every.columns[1:])


def _first_of(df: DataFrame, names: tuple[str, ...], default: str) -> Column:
    there = [F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(default))


def to_contact_schema(df: DataFrame, unknown: str = "Unknown Company") -> DataFrame:
    """Either layout as the nine contact columns, with file and ord if there."""
    old = {"company_name": "name", "website": "website", "all_emails_found": "emails"}
    values = [_first_of(df, (header, name, *([old[name]] if name in old else [])), unknown if name == "company_name" else "").alias(name) for name, header in C.CONTACT_COLUMNS.items()]
    return df.select(*[c for c in ("file", "ord") if c in df.columns], *values)


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """(ord, city), one a line; quotes, blank lines and # lines dropped."""
    city = F.btrim(trimmed("value"), F.lit("\"'"))
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), city.alias("city")).where((F.col("city") != "") & ~F.startswith("city", F.lit("#")))


def parse_city_list(df: DataFrame, column: str) -> DataFrame:
    """(ord, city) of a `;`-separated list."""
    return df.select(F.posexplode(F.split(column, ";")).alias("ord", "city")).select("ord", trimmed("city").alias("city")).where("city <> ''")


def read_geo_elements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GEO_ELEMENT).json(path)


def read_place_results(spark: SparkSession, path: str) -> DataFrame:
    return place_rows(spark.read.schema(PLACE_RESULT).json(path))


def place_rows(places: DataFrame) -> DataFrame:
    """(id, name, website, phone) of place results: the first http website and phone, one row an id, both name and website."""
    www = F.flatten(F.transform("contacts", lambda c: F.transform(F.coalesce(c["www"], F.array().cast("array<struct<value:string>>")), lambda w: w["value"])))
    phones = F.flatten(F.transform("contacts", lambda c: F.transform(F.coalesce(c["phone"], F.array().cast("array<struct<value:string>>")), lambda p: p["value"])))
    site = F.get(F.filter(www, lambda w: F.startswith(w, F.lit("http"))), F.lit(0))
    phone = F.coalesce(F.get(F.filter(phones, lambda p: p != ""), F.lit(0)), F.lit(""))
    rows = places.select("id", trimmed("title").alias("name"), site.alias("website"), phone.alias("phone")).where("name <> '' and website is not null")
    return rows.groupBy("id").agg(F.min(F.struct("name", "website", "phone")).alias("x")).select("id", "x.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_dns_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DNS_ANSWER).parquet(path)


def write_contacts(df: DataFrame, path: str, form: str = "csv") -> None:
    """One folder per niche and location, original headers; only the folders of df are replaced."""
    named = df.select(*[F.col(n).alias(h) for n, h in C.CONTACT_COLUMNS.items()], "niche", "location")
    named.write.partitionBy("niche", "location").mode("overwrite").option("header", True).option("partitionOverwriteMode", "dynamic").format(form).save(path)


def write_report(df: DataFrame, path: str) -> None:
    df.select(F.col("email").alias("Email"), F.col("company").alias("Company"), F.col("status").alias("Status"), F.col("reason").alias("Reason")).write.option("header", True).csv(path)


def processed_emails(log: DataFrame) -> DataFrame:
    """Distinct lower-case addresses of a log, in either of its columns."""
    return log.select(F.lower(_first_of(log, ("Recipient Email", "recipient_email", "Email", "email"), "")).alias("email")).select(trimmed("email").alias("email")).where("email <> ''").distinct()


def append_processed_log(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Appends rows, with the time, to a log. Those of a numbered batch replace what an earlier try of it has written, so a batch that is tried again is there once."""
    rows = df.withColumn("timestamp", F.current_timestamp())
    if batch is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


