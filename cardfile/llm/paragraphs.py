"""Substring dedup: repeated paragraphs by MinHash banding.

Repeated passages keep neither to lines nor to sentences, so paragraphs are cut
where the words themselves say: a word begins one if its value is the least of
some WINDOW values in a row (winnowing). Copies of a passage are cut alike
inside, wherever they stand. Paragraphs whose signatures agree in a band meet
in a bucket; their exact Jaccard similarity over word shingles is verified, and
the similar ones form components, of which the first occurrence stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardfile.llm.components import components
from cardfile.llm.hashing import grams_of, word_hashes
from cardfile.llm.workers import give_back
from cardfile.sources.store import cut, text_batches

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Share of pairs at SIMILARITY that meet in a bucket; more alike ones meet more often, equal ones always.
RECALL = 0.99
BAND_ROWS = 2
#: Of so many values in a row the least one begins a paragraph; as a value is made of VALUE_WORDS words, every passage of
#: 2 * WINDOW + VALUE_WORDS - 1 (50) words or more holds a whole paragraph, the same in all its copies.
WINDOW = 24
VALUE_WORDS = 3
#: Shorter paragraphs repeat by chance and are left alone.
MIN_WORDS = 8
#: Repeated paragraphs count if they and the ones next to them that repeat too have at least so many words in all.
SPAN_WORDS = 16
#: Buckets of up to so many paragraphs give all their pairs; larger ones are linked in blocks.
PAIRED = 16
BLOCK = 1024
#: Paragraphs whose buckets a task has named, at most; it may name those of others again.
NAMED = 1 << 18
#: Words of the texts that are held at once, beside those of the last text.
HELD_WORDS = 1 << 20
SEED = 11
PRIME = (1 << 31) - 1
#: Weights of a word's first and last character and its length, then of the words of a value.
CHARACTER_WEIGHTS = (7919, 104729, 1299709)
WORD_WEIGHTS = (48271, 69621, 16807)


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """The fewest bands of so many rows that let `recall` of the pairs at `similarity` collide."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class Words(NamedTuple):
    """A text's words, apart at white space: their hashes, places in code points (ends exclusive) and values."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    values: np.ndarray


def words_of(text: str | None) -> Words:
    data = (text or "").encode("utf-8", "replace").lower()
    if data.isascii():
        points = np.frombuffer(data, np.uint8)
    else:
        points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        points = np.where((points >= 65) & (points <= 90), points + 32, points)
    space = np.ones(len(points) + 2, np.int8)
    space[1:-1] = (points == 32) | ((points >= 9) & (points <= 13))
    edges = np.diff(space)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    told = np.stack((points[starts], points[ends - 1], ends - starts)).astype(np.int64) if len(starts) else np.empty((3, 0), np.int64)
    told = np.dot(CHARACTER_WEIGHTS, told) % PRIME
    values = np.zeros(len(starts), np.int64)
    for i, weight in enumerate(WORD_WEIGHTS[:VALUE_WORDS]):
        values[: max(0, len(told) - i)] += told[i:] * weight % PRIME
    return Words(word_hashes(data.split()), starts, ends, values % PRIME)


def beginnings(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The first word of each paragraph: the first of all, and the last least value of each window."""
    if not len(values):
        return np.empty(0, np.int64)
    if len(values) < window:
        return np.zeros(1, np.int64)
    least = (values << 32) | (0xFFFFFFFF - np.arange(len(values)))
    done = 1
    while done < window:  # in steps that double
        step = min(done, window - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return np.unique(np.append(0xFFFFFFFF - (least & 0xFFFFFFFF), 0))


class MinHash:
    """Signatures of `bands` times `rows` minima, as one bucket number for each band."""

    def __init__(self, bands: int, rows: int = BAND_ROWS):
        random = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        self.factors = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def buckets(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sets, bands): the buckets of sets of hashes that lie one after another and begin at these places."""
        out = np.tile(np.arange(self.bands, dtype=np.uint64), (len(starts), 1))
        for i in range(self.bands * self.rows):
            mixed = (hashes ^ self.salts[i]) * self.factors[i]
            mixed ^= mixed >> np.uint64(32)
            band = out[:, i // self.rows]
            band ^= np.minimum.reduceat(mixed, starts)
            band *= np.uint64(0x9E3779B97F4A7C15)
            band ^= band >> np.uint64(31)
        return out.view(np.int64)


class Paragraphs(NamedTuple):
    """Those of one text with enough words: ordinal among all, first word, number of words, print, and the shingles of each, joined."""

    nth: np.ndarray
    first: np.ndarray
    n_words: np.ndarray
    prints: np.ndarray
    shingles: np.ndarray
    shingle_starts: np.ndarray


def paragraphs_of(words: Words, min_words: int = MIN_WORDS, shingle_words: int = SHINGLE_WORDS, window: int = WINDOW) -> Paragraphs:
    """Paragraphs of at least min_words words; prints are hashes of all words, equal for equal paragraphs."""
    first = beginnings(words.values, window)
    sizes = np.diff(np.append(first, len(words.hashes)))
    nth = np.flatnonzero(sizes >= max(min_words, shingle_words))
    first, sizes = first[nth], sizes[nth]
    if not len(nth):
        return Paragraphs(nth, first, sizes, np.empty(0, np.int64), np.empty(0, np.uint64), nth[:0])
    begins = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
    mixed = (words.hashes[np.repeat(first, sizes) + within] ^ (within.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    prints = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), begins)
    grams = sizes - shingle_words + 1
    gram_begins = np.cumsum(grams) - grams
    at = np.repeat(first - gram_begins, grams) + np.arange(int(grams.sum()))
    return Paragraphs(nth, first, sizes, prints.view(np.int64), grams_of(words.hashes, shingle_words)[at], gram_begins)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar_forest(sets: list[np.ndarray], left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect whatever similar pairs between left and the other entries connect.

    left: a mask; where it is all true, pairs within are meant. Every entry is
    compared once with all that are not yet linked, through an inverted index.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    open_ = np.ones(len(sets), bool)
    within = bool(left.all())
    links = []
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start] = False
        front = [start]
        while front:
            i = front.pop()
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            met = np.concatenate([owner[a:b] for a, b in zip(lo, hi)]) if len(lo) else np.empty(0, int)
            met = met[open_[met]]
            if not within:
                met = met[left[met] != left[i]]
            both = np.bincount(met, minlength=len(sets))
            hit = np.flatnonzero((both > 0) & (both >= similarity * (sizes + sizes[i] - both) - 1e-9))
            open_[hit] = False
            front += hit.tolist()
            links += [(i, j) for j in hit.tolist()]
    return links


def _lists(there: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list for each place: as many of the values as its size where one is there, else null."""
    own = np.zeros(len(there), np.int64)
    own[there] = sizes
    offsets = np.concatenate(([0], np.cumsum(own)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array(~there))


def signed_batch(batch: pa.RecordBatch, held: list[Paragraphs], places: list[tuple], named: set[int], minhash: MinHash) -> pa.RecordBatch:
    """The paragraphs of some texts of a batch as rows, with buckets and shingle hashes where `named` has not had them; it has then."""
    at, start, end = (np.concatenate(x) for x in zip(*places))
    nth, _, n_words, prints, shingles, _ = (np.concatenate(x) for x in zip(*held))
    sizes = np.concatenate([np.diff(np.append(p.shingle_starts, len(p.shingles))) for p in held])
    values, where = np.unique(prints, return_index=True)
    fresh = np.fromiter((p not in named for p in values.tolist()), bool, len(values))
    named.update(values[fresh].tolist())
    there = np.zeros(len(prints), bool)
    there[where[fresh]] = True
    own, sizes = shingles[np.repeat(there, sizes)], sizes[there]
    buckets = minhash.buckets(own, np.cumsum(sizes) - sizes) if len(sizes) else np.empty((0, minhash.bands), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("row").take(pa.array(at)), batch.column("id").take(pa.array(at)), *(pa.array(x.astype(np.int64)) for x in (nth, start, end, n_words, prints)),
            _lists(there, np.full(len(sizes), minhash.bands), buckets.ravel()), _lists(there, sizes, own.astype(np.uint32).view(np.int32)),
        ],
        ["row", "id", "paragraph", "start", "end", "n_words", "print", "buckets", "hashes"],
    )


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, span_words: int = SPAN_WORDS, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows_per_band: int = BAND_ROWS, window: int = WINDOW) -> DataFrame:
    """One row per paragraph that repeats: id_col, paragraph, start, end, n_words, span_start, span_end, class_id, class_paragraph, class_size, removed.

    A class is a component of similar paragraphs, named by its first occurrence
    (least id, then paragraph), which is the one not removed. A span is made of
    paragraphs in a row that all repeat; those of fewer than span_words words are
    left out. Places are code points of the whole text, ends exclusive. Null and
    empty texts have no paragraphs; those of fewer than min_words (at least
    shingle_words) words are not looked at, which also holds for text that
    repeats itself every few words. Rows with a null id take part and come last
    in their class; repeated rows are occurrences each. Columns beyond the two
    named are not read. An empty table gives an empty table. Equal paragraphs
    are one entry in the search.
    """
    minhash = MinHash(tuned_bands(similarity, recall, rows_per_band), rows_per_band)
    rows = text_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: set[int] = set()  # a paragraph's buckets and shingles go on once a task, however often it stands there
        for batch in batches:
            held, places, size = [], [], 0
            for at, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                found = paragraphs_of(words, min_words, shingle_words, window)
                if len(found.nth):
                    held.append(found)
                    places.append((np.full(len(found.nth), at), words.starts[found.first], words.ends[found.first + found.n_words - 1]))
                    size += len(words.hashes)
                if size > HELD_WORDS or at == batch.num_rows - 1 and held:
                    yield signed_batch(batch, held, places, named, minhash)
                    held, places, size = [], [], 0
            if len(named) > NAMED:
                named.clear()
        give_back()

    seen = cut(rows.mapInArrow(signed, "row long, id string, paragraph long, start long, end long, n_words long, print long, buckets array<long>, hashes array<int>"), "paragraphs")
    seen = seen.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))  # as text it passed pandas whole, nulls or not
    # one shuffle by bucket serves the distinct, the count and the join
    met = seen.where("buckets is not null").select("print", F.explode("buckets").alias("bucket")).repartition("bucket").distinct()
    members = cut(met.join(met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "members")
    prints = members.select("print").distinct()
    sets = cut(seen.where("hashes is not null").select("print", "hashes").join(prints, "print").dropDuplicates(["print"]), "sets")

    cold = members.where(F.col("n") <= PAIRED).select("bucket", "print")
    pairs = cold.select("bucket", F.col("print").alias("a")).join(cold.select("bucket", F.col("print").alias("b")), "bucket").where("a < b").select("a", "b").distinct()

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(np.unique(a), np.unique(b)) for a, b in zip(x, y)])

    both = pairs.join(sets.select(F.col("print").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("print").alias("b"), F.col("hashes").alias("y")), "b")
    links = both.withColumn("alike", alike("x", "y")).where(F.col("alike") >= similarity - 1e-9).select("a", "b")

    hot = members.where(F.col("n") > PAIRED).withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("print"), "parts"))
    turns = hot.select("bucket", "print", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = turns.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "print").join(sets, "print")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        found = similar_forest([np.unique(h) for h in pdf["hashes"]], (pdf["own"] == pdf["i"]).to_numpy(), similarity)
        at = pdf["print"].to_numpy()
        return pd.DataFrame({"a": [at[i] for i, _ in found], "b": [at[j] for _, j in found]}, dtype="int64")

    links = links.unionByName(blocks.groupBy("bucket", "i", "j").applyInPandas(linked, "a long, b long"))
    classes = components(links).withColumnRenamed("node", "print")

    first = F.struct(F.col("id").isNull().alias("late"), "id", "paragraph", "row")
    once = seen.groupBy("print").agg(F.count("*").alias("n"), F.min(first).alias("first")).join(classes, "print", "left").withColumn("class", F.coalesce("component", "print"))
    kept = once.groupBy("class").agg(F.min("first").alias("first"), F.sum("n").alias("class_size")).where("class_size > 1")
    named = once.select("print", "class").join(kept, "class").drop("class")
    found = seen.select("row", "id", "paragraph", "start", "end", "n_words", "print").join(named, "print")
    island = Window.partitionBy("row", "island")
    found = found.withColumn("island", F.col("paragraph") - F.row_number().over(Window.partitionBy("row").orderBy("paragraph")))
    found = found.withColumns({"span": F.sum("n_words").over(island), "span_start": F.min("start").over(island), "span_end": F.max("end").over(island)}).where(F.col("span") >= span_words)
    return found.select(
        F.col("id").alias(id_col), "paragraph", "start", "end", "n_words", "span_start", "span_end", F.col("first.id").alias("class_id"), F.col("first.paragraph").alias("class_paragraph"), "class_size",
        (~((F.col("first.row") == F.col("row")) & (F.col("first.paragraph") == F.col("paragraph")))).alias("removed"),
    )
