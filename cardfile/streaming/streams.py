"""Contact files as they arrive, and suppression of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cardfile.functions import scalars as S
from cardfile.operators.clean import clean_contacts
from cardfile.sources.store import exists
from cardfile.sources.tables import append_processed_log, processed_emails, read_contact_files, to_contact_schema


def contact_stream(spark: SparkSession, folder: str, schema: StructType | str, form: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(folder)


def clean_contacts_stream(stream: DataFrame, path: str, checkpoint: str, strict: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Cleaned rows appended to path; the checkpoint remembers which files are done."""
    return clean_contacts(stream, strict).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(path)


def suppress_repeats_stream(stream: DataFrame, log: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows whose address is not in the log and was not seen within the delay; state is bounded by it."""
    keyed = stream.withColumn("email_key", F.lower(S.trimmed("email"))).withWatermark(time, delay)
    fresh = keyed.join(processed_emails(log).withColumnRenamed("email", "_done"), F.col("email_key") == F.col("_done"), "left_anti")
    return fresh.dropDuplicatesWithinWatermark(["email_key"])


#: Each try of a batch overwrites what an earlier one has written, so every batch is there once.
def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def contact_file_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, strict: bool = False, files_per_trigger: int = 100, trigger: dict | None = None) -> StreamingQuery:
    """Contact files of any layouts as they arrive, cleaned, to path: file, ord and the contact columns, by batch.

    The stream carries the names of new files; in each batch they are read by their
    header as read_contacts does, so layouts may be mixed and files with "sent" in their name, or
    without an address column, give nothing. A batch that is tried again replaces its own rows.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path")

    def clean(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.distinct().collect()]  # files_per_trigger at most
        rows = to_contact_schema(read_contact_files(batch.sparkSession, paths))
        _write_batch(clean_contacts(rows, strict), path, number)

    return files.writeStream.foreachBatch(clean).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The stream's rows appended to a processed log, each batch exactly once however often it is tried."""
    return stream.writeStream.foreachBatch(lambda batch, number: append_processed_log(batch, path, number)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _ordered_times(times: str, delay_seconds: float):
    """Of an address's times in order, with the last one kept before them as `last`: those that no kept one precedes by less than the delay."""
    seconds = lambda t: F.unix_micros(t) / 1_000_000
    start = F.struct(F.col("last").alias("last"), F.array().cast("array<timestamp>").alias("kept"))
    free = lambda acc, t: acc["last"].isNull() | (seconds(t) - seconds(acc["last"]) >= delay_seconds)
    step = lambda acc, t: F.when(free(acc, t), F.struct(t.alias("last"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc)
    return F.aggregate(times, start, step, lambda acc: acc["kept"])


def suppress_with_expiry_stream(stream: DataFrame, path: str, checkpoint: str, time: str = "ts", delay: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Kept rows (email_key, time) to path/kept and late ones to path/late, by batch.

    An address that was kept is suppressed for `delay` of event time and then free
    again; a time before that of a kept row is suppressed too. A row is late if its time is more than the delay before the latest one of the
    earlier batches: what it would repeat may be forgotten by then. Of an address
    and time one row counts. State is the tables themselves: of the kept rows only
    those within twice the delay of the latest time are read again. Rows without
    an address or a time are dropped. A batch that is tried again replaces its own rows.
    """
    spark = stream.sparkSession
    seconds = float(spark.range(1).select((F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"interval {delay}")) - F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp"))) / 1_000_000).first()[0])
    before = lambda t, times: F.timestamp_micros(F.unix_micros(t) - F.lit(int(times * seconds * 1_000_000)))

    def split(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.select(F.lower(S.trimmed("email")).alias("email_key"), F.col(time).alias("at")).where("email_key <> '' and at is not null")
        marks, kept = f"{path}/marks", f"{path}/kept"
        latest = session.read.parquet(marks).where(F.col("batch") < number).agg(F.max("latest")).first()[0] if exists(session, marks) else None
        late = (F.col("at") < before(F.lit(latest), 1)) if latest is not None else F.lit(False)
        fresh = rows.where(~late).groupBy("email_key").agg(F.sort_array(F.collect_set("at")).alias("times"))
        if latest is not None:
            recent = session.read.parquet(kept).where((F.col("batch") < number) & (F.col("at") >= before(F.lit(latest), 2)))
            fresh = fresh.join(recent.groupBy("email_key").agg(F.max("at").alias("last")), "email_key", "left")
        else:
            fresh = fresh.withColumn("last", F.lit(None).cast("timestamp"))
        _write_batch(rows.where(late).distinct(), f"{path}/late", number)
        _write_batch(fresh.select("email_key", F.explode(_ordered_times("times", seconds)).alias("at")), kept, number)
        _write_batch(rows.agg(F.max("at").alias("latest")).where("latest is not null"), marks, number)

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
