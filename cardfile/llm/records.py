"""Token ids as length-delimited binary records with an offset index.

A record is: length of the payload (unsigned 64-bit), its masked checksum
(32-bit), the payload, the payload's masked checksum (32-bit), and the line
end that Spark's text writer puts after each row. All numbers are
little-endian. Checksums are CRC-32, rotated and shifted by a constant, so that
a checksum of data that holds checksums stays a good one. A payload is the id
(signed 64-bit), the width of a token id in bytes, whether there is an id, two
zero bytes, and the token ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardfile.llm import tokens
from cardfile.llm.workers import give_back
from cardfile.sources.store import text_batches

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: At most so many files' starts (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_FILES = 1 << 16
#: Text of a file: its records take about as much, and readers hold a file at a time.
FILE_BYTES = 64 << 20
_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_KEY = struct.Struct("<qB?2x")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    """One record without the line end."""
    payload = _KEY.pack(key or 0, ids.dtype.itemsize, key is not None) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(content: bytes, offset: int = 0, verify: bool = True) -> tuple[int | None, np.ndarray, int]:
    """The key, the ids, and where the next record begins; a record that is cut short or changed raises ValueError."""
    if offset + _HEAD.size > len(content):
        raise ValueError(f"record at {offset} is cut short")
    length, check = _HEAD.unpack_from(content, offset)
    if check != masked(content[offset : offset + 8]):
        raise ValueError(f"length at {offset} has a wrong checksum")
    at = offset + _HEAD.size
    payload = content[at : at + length]
    if len(payload) < length or len(content) < at + length + 5:
        raise ValueError(f"record at {offset} is cut short")
    if verify and struct.unpack_from("<I", content, at + length)[0] != masked(payload):
        raise ValueError(f"record at {offset} has a wrong checksum")
    key, width, there = _KEY.unpack_from(payload)
    return key if there else None, np.frombuffer(payload, f"<u{width}", offset=_KEY.size), at + length + 5


def write_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END, files: int | None = None) -> None:
    """Writes path/records (binary files in ascending id order) and path/index.

    Every text becomes one record of its token ids and the end id; null texts
    are empty, null ids come first, repeated ids and rows each get a record.
    files: how many to write; if None, as many as hold FILE_BYTES of text each,
    and the session's shuffle partitions at least. The index, Parquet, has per record: file, record, offset, length, id, start (tokens
    before it in its file) and n_tokens. No rows give an empty index.
    """
    spark = docs.sparkSession
    rows = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.load(tokenizer)
        end = np.array([end_id], encoder.dtype)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                keys = (None if pd.isna(k) else int(k) for k in part["id"])
                yield pd.DataFrame({"record": [frame(k, np.concatenate((ids, end))) for k, ids in zip(keys, encoder.encode(part["text"]))]})
        give_back(encoders=True)

    # ids pass through pandas as text: whole numbers with nulls would become floats;
    # text files: Spark commits them task by task, on whatever store the path names
    ranged.withColumn("id", F.col("id").cast("string")).mapInPandas(framed, "record binary").select(F.col("record").cast("string").alias("value")).write.text(f"{path}/records")
    _read(spark, path, False, False).drop("ids").write.parquet(f"{path}/index")


_INDEX = "file string, record long, offset long, length long, id long, start long, n_tokens long"


def _read(spark: SparkSession, path: str, verify: bool, with_ids: bool) -> DataFrame:
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"]):
                at = record = start = 0
                out = []
                while at < len(content):
                    key, ids, then = unframe(content, at, verify)
                    out.append((name, record, at, then - at, key, start, len(ids), ids.astype("<u4").tobytes() if with_ids else None))
                    record, start, at = record + 1, start + len(ids), then
                    if len(out) == 1000 or at == len(content):
                        made = pd.DataFrame(out, columns=["file", "record", "offset", "length", "id", "start", "n_tokens", "ids"])
                        made["id"] = made["id"].astype("Int64")
                        yield made
                        out = []
        give_back()

    spark_files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records").where("length > 0")
    named = spark_files.select(F.substring_index("path", "/", -1).alias("file"), "content")
    # one file in a batch: a task holds no more than one in Python
    return named.mapInPandas(parsed, f"{_INDEX}, ids binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record in order of file and record, checksums verified, with its token ids (unsigned 32-bit, little-endian).

    As the index, with ids, and start counted over all files.
    """
    index = spark.read.parquet(f"{path}/index")
    sums = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    nth = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")  # by number: names sort wrong beyond 99,999 files
    earlier = Window.orderBy(nth, "file").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # one row a file: broadcast up to a bound, so that the ids need no shuffle
    if index.select("file").distinct().count() <= BROADCAST_FILES:
        before = F.broadcast(before)
    return _read(spark, path, True, True).join(before, "file").select("file", "record", "offset", "length", "id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def read_shuffled(spark: SparkSession, path: str, seed: int, share: float = 1.0) -> DataFrame:
    """Records in an order that the seed decides, by the index: position, id, ids.

    share: the part of the records to read, chosen by the same hash. Only the
    indexed ranges of each file are decoded.
    """
    index = spark.read.parquet(f"{path}/index")
    turn = F.xxhash64(F.lit(seed), "file", "record")
    picked = index.withColumn("turn", turn).where(F.pmod("turn", F.lit(1 << 20)) < share * (1 << 20))
    ranges = picked.groupBy("file").agg(F.collect_list(F.struct("turn", "offset")).alias("ranges"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    both = ranges.join(files.select(F.substring_index("path", "/", -1).alias("file"), "content"), "file")

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, wanted in zip(pdf["content"], pdf["ranges"]):
                out = [(r["turn"], *unframe(content, r["offset"])[:2]) for r in wanted]
                made = pd.DataFrame({"turn": [x[0] for x in out], "id": [x[1] for x in out], "ids": [x[2].astype("<u4").tobytes() for x in out]})
                made["id"] = made["id"].astype("Int64")
                yield made

    return both.select("content", "ranges").mapInPandas(sliced, "turn long, id long, ids binary").orderBy("turn", "id").drop("turn")
