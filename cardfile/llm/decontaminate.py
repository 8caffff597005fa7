"""Benchmark decontamination by winnowing.

Of the k-gram hashes in every window of SPAN - K + 1 positions the least is
kept, so a text and an item that share SPAN words share a kept hash. Kept
hashes are joined, and each document and item that meet there are extended
into the spans which they really share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardfile.llm.hashing import grams_of, word_hashes
from cardfile.llm.workers import give_back
from cardfile.sources.store import cut, text_batches

SPAN = 13
K = 8
#: At most so many benchmark hashes (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_HASHES = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and bytes beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


def winnow(hashes: np.ndarray, span: int = SPAN, k: int = K) -> np.ndarray:
    """The distinct least k-gram hashes of every `span` words."""
    grams = grams_of(hashes, k)
    size = span - k + 1
    if len(grams) < size:
        return np.empty(0, np.uint64)
    least = grams[: len(grams) - size + 1]
    for i in range(1, size):
        least = np.minimum(least, grams[i : len(grams) - size + 1 + i])
    return np.unique(least)


def item_hashes(text: bytes | None, span: int = SPAN, k: int = K) -> np.ndarray:
    """What a document must meet to hold a window of the item: of a short item the hash of all its words."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    hashes = word_hashes(found)
    return winnow(hashes, span, k) if len(found) >= span else grams_of(hashes, len(found))


def document_hashes(found: list[bytes], short: list[int], span: int = SPAN, k: int = K) -> np.ndarray:
    """The winnowed hashes of a document, and those of all its runs as long as some short item."""
    hashes = word_hashes(found)
    return np.unique(np.concatenate([winnow(hashes, span, k), *(grams_of(hashes, n) for n in short)]))


def shared_spans(document: list[bytes], item: list[bytes], span: int = SPAN) -> list[int]:
    """Flat list of start, end (exclusive) of the document's words under any window of the item, merged."""
    n = min(span, len(item))
    if not n or len(document) < n:
        return []
    windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    heads = {w[0] for w in windows}
    out: list[int] = []
    for i in range(len(document) - n + 1):
        if document[i] in heads and tuple(document[i : i + n]) in windows:
            if out and i <= out[-1]:
                out[-1] = i + n
            else:
                out += [i, i + n]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, broadcast_hashes: int = BROADCAST_HASHES, with_text_hash: bool = False) -> DataFrame:
    """Per row of docs: id_col, n_words, n_hit, items (array of strings, sorted), spans; with_text_hash also text_hash, which tells rows of one id apart.

    A window is `span` words in a row of an item, or all words of a shorter
    item that has any. n_hit counts the document's words under windows that
    occur in it; spans lists their merged runs as structs (item, start, end) of
    word positions. Null and word-less texts have no words and no windows; an
    item that is there twice counts once; items with a null id hit words but
    are not named. Repeated rows and ids each keep their row. Either table may
    be empty. Other columns are not read.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("item_text")).distinct()

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([item_hashes(t, span, k).view(np.int64) for t in texts])

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words(t)) for t in texts], dtype="int64")

    # items go by number until their texts are needed
    bench = cut(bench.withColumn("item_words", counted("item_text")).where("item_words > 0").withColumn("hashes", hashed("item_text")).withColumn("nth", F.monotonically_increasing_id()), "benchmark")
    short = sorted(r[0] for r in bench.where(F.col("item_words") < span).select("item_words").distinct().collect())
    wanted = bench.select(F.explode("hashes").alias("h"), "nth")
    few = wanted.select("h").distinct().limit(broadcast_hashes + 1)
    known = None
    if few.count() <= broadcast_hashes:
        known = spark.sparkContext.broadcast(np.sort(few.toPandas()["h"].to_numpy(np.int64).view(np.uint64)))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            out = {"row": range(row, row + len(pdf)), "id": pdf["id"], "text_hash": pdf["text_hash"], "n_words": [], "met": [], "text": []}
            row += len(pdf)
            for text in pdf["text"]:
                found = words(text)
                met = document_hashes(found, short, span, k) if found else np.empty(0, np.uint64)
                if known is not None and len(met):
                    at = np.searchsorted(known.value, met)
                    at[at == len(known.value)] = 0
                    met = met[known.value[at] == met] if len(known.value) else met[:0]
                out["n_words"].append(len(found))
                out["met"].append(met.view(np.int64))
                out["text"].append(text if len(met) else None)
            yield pd.DataFrame(out)
        give_back()

    # ids pass through pandas as text: whole numbers with nulls would become floats
    rows = text_batches(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"), _text_hash(text_col).alias("text_hash"))
    schema = "row long, id string, text_hash long, n_words long, met array<long>, text binary"
    seen = cut(rows.mapInPandas(find, schema), "met")
    pairs = seen.where(F.size("met") > 0).select("row", F.explode("met").alias("h")).join(wanted, "h").select("row", "nth").distinct()

    @F.pandas_udf("array<long>")
    def extended(documents: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([shared_spans(words(d), words(i), span) for d, i in zip(documents, items)])

    both = pairs.join(seen.where("text is not null").select("row", "text"), "row").join(bench.select("nth", "item", "item_text"), "nth")
    hits = both.select("row", "item", extended("text", "item_text").alias("runs")).where(F.size("runs") > 0)
    runs = hits.select("row", "item", F.explode(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2))).alias("i"), "runs").select("row", "item", F.get("runs", F.col("i")).alias("start"), F.get("runs", F.col("i") + 1).alias("end"))
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = runs.withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = new.groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "upto"))).alias("n_hit"),
        F.sort_array(F.collect_set("item")).alias("items"),
        F.sort_array(F.collect_list(F.struct("item", "start", "end"))).alias("spans"),
    )
    more = ["text_hash"] if with_text_hash else []
    out = seen.select("row", "id", "n_words", *more).join(hit, "row", "left")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", *more)


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """A document counts as contaminated from a twentieth of its words on."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, with their own columns, whose text is not contaminated, whatever another row with their id holds. Rows with a null id are kept."""
    found = contamination(docs, benchmark, id_col, text_col, with_text_hash=True, **settings)
    bad = found.where(contaminated()).select(F.col(id_col).alias("_bad"), F.col("text_hash").alias("_bad_text")).distinct()
    return docs.join(bad, (docs[id_col] == bad["_bad"]) & (_text_hash(text_col) == bad["_bad_text"]), "left_anti")
