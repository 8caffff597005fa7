"""Threshold-scaled sketches of documents.

Every shingle hash below a fixed fraction of the hash range is kept, whatever
the text's length. So sketches of long texts are larger, the sketch of a union
is the union of sketches, and the share of a short text's hashes found in a
long text's sketch estimates how much of the short one the long one holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardfile.llm.hashing import grams_of, word_hashes
from cardfile.llm.workers import give_back
from cardfile.sources.store import cut, text_batches

SHINGLE_WORDS = 5
#: Hashes below this part of the hash range are kept.
FRACTION = 1 / 16


def sketch(text: str | None, fraction: float = FRACTION, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct kept hashes of a text's shingles in ascending order.

    Words are runs without ASCII white space, A-Z lower-cased; fewer words than a
    shingle are one shingle. Of a text with words of which no hash is below the
    fraction the least is kept alone, so only texts without words have none.
    """
    words = (text or "").encode().lower().split()
    hashes = grams_of(word_hashes(words), max(1, min(shingle_words, len(words))))
    return kept(hashes, fraction)


def kept(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    low = hashes[hashes < np.uint64(min(int(fraction * 2**64), 2**64 - 1))]
    return np.unique(low if len(low) else hashes.min(keepdims=True) if len(hashes) else hashes)


def merged(sketches: Iterable[np.ndarray], fraction: float = FRACTION) -> np.ndarray:
    """The sketch of several texts' shingles together, from their sketches."""
    parts = list(sketches)
    return kept(np.concatenate(parts) if parts else np.empty(0, np.uint64), fraction)


def containment(part: np.ndarray, whole: np.ndarray) -> float:
    """The estimated share of part's shingles that whole has; of two without any 1."""
    if not len(part):
        return float(not len(whole))
    return len(np.intersect1d(part, whole, assume_unique=True)) / len(part)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How much of the one with fewer hashes the other holds, from 0 to 1."""
    return containment(*sorted((a, b), key=len)) if len(a) and len(b) else float(len(a) == len(b))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of following as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def sketch_column(text: Column | str, fraction: float = FRACTION, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The sketch as a binary of little-endian unsigned 64-bit hashes."""

    @F.pandas_udf("binary")
    def sketched(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t, fraction, shingle_words).tobytes() for t in texts])

    return sketched(text)


def as_text(hashes: Column | str) -> Column:
    """A sketch as lowercase hex digits, 16 for each hash, in their order in memory."""
    return F.lower(F.hex(hashes))


def sketch_rows(docs: DataFrame, id_col: str, text_col: str = "text", **settings) -> DataFrame:
    """(id_col, hash): the distinct hashes of all texts that share id_col; with a document's id its sketch, with its source the source's.

    Sketches are made and reduced in each task before they are shuffled, by id
    and hash, so a group of any size is dealt out. A group none of whose hashes is
    below the fraction keeps its least one. Null ids are a group; texts
    without words give no row.
    """
    fraction = settings.get("fraction", FRACTION)

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t, **settings).view(np.int64) for t in texts])

    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.explode(hashes(text_col)).alias("hash")).distinct()
    # hashes are unsigned: with the sign bit turned they are in order as longs
    order, bound = F.col("hash").bitwiseXOR(F.lit(-(2**63))), F.lit(min(int(fraction * 2**64), 2**64 - 1) - 2**63)
    least = rows.groupBy(F.col("id").alias("of")).agg(F.min(order).alias("least"))
    both = rows.join(least, F.col("id").eqNullSafe(F.col("of"))).where((order < bound) | ((F.col("least") >= bound) & (order == F.col("least"))))
    return both.select(F.col("id").alias(id_col), "hash")


_SCHEMA = "part int, head boolean, id string, n_chars long, edited_sha256 binary, sketch binary, edited_sketch binary, near_edited double, near_next double, text string"


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of docs: id_col, n_chars, edited_sha256 (hex), sketch, edited_sketch (binary), near_edited, near_next.

    The next row is the one that follows by id (null ids first, rows of one id
    by a hash of the text, then the text); after the last comes the first, so
    a single row is its own next one. The edited text is the row's with its last half replaced
    by as much of the next one's beginning. A null text is empty; two texts without
    words are alike (1.0), one with and one without are not (0.0). Repeated rows
    each keep theirs. An empty table gives an empty table. Other columns are not read.

    Texts are shuffled once, by ranges of (id, hash), so one id may hold any
    share of the rows; each task reads its range in order with one row in hand. Only
    the first and last text of each range are kept for what crosses ranges.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = text_batches(docs).select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select(F.col("id").cast("string").alias("id"), "text")

    def described(own: tuple, following: tuple) -> tuple:
        changed = edited(own[1], following[1])
        new = sketch(changed, fraction, shingle_words)
        return len(own[1]), hashlib.sha256(changed.encode()).digest(), own[2].tobytes(), new.tobytes(), likeness(own[2], new), likeness(own[2], following[2])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before, names = TaskContext.get().partitionId(), None, _NAMES
        for pdf in batches:
            out = []
            for key, text in zip(pdf["id"], pdf["text"]):
                row = (key, text, sketch(text, fraction, shingle_words))
                if before is None:
                    out.append((part, True, *(None,) * 7, text))
                else:
                    out.append((part, False, before[0], *described(before, row), None))
                before = row
            yield pd.DataFrame(out, columns=names)
        if before is not None:
            yield pd.DataFrame([(part, False, before[0], *(None,) * 6, before[1])], columns=names)
        give_back()

    seen = cut(dealt.mapInPandas(walk, _SCHEMA), "sketches")
    heads = seen.where("head").select("part", F.col("text").alias("following"))
    ends = seen.where(~F.col("head") & F.col("text").isNotNull()).select("part", "id", "text")
    # one narrow row for each range
    order = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("next_part"))
    wrapped = order.join(F.broadcast(heads.agg(F.min("part").alias("first_part")))).select("part", F.coalesce("next_part", "first_part").alias("next_part"))
    crossing = ends.join(wrapped, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part").select("part", "id", "text", "following")

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for part, key, own, following in pdf.itertuples(index=False):
                pair = [(None, t, sketch(t, fraction, shingle_words)) for t in (own, following)]
                out.append((part, False, key, *described(*pair), None))
            yield pd.DataFrame(out, columns=_NAMES)

    inner = seen.where(~F.col("head") & F.col("text").isNull())
    both = inner.unionByName(crossing.mapInPandas(cross, _SCHEMA))
    return both.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), "sketch", "edited_sketch", "near_edited", "near_next")


_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]
