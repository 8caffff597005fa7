"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most
`radius` bits, then in some segment they differ in few bits; so each one looks
up, in a table of all segments, every value in a small Hamming ball round its
own segment, and the complete distance is verified for what it meets there.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cardfile.llm.components import components
from cardfile.llm.workers import give_back
from cardfile.sources.store import cut, text_batches

SHINGLE_WORDS = 4
RADIUS = 4
#: Numbers of segments to choose from; fewer are longer, which takes more probes and meets fewer others by chance.
SEGMENTS = (2, 3, 4)
SEED = 42
#: Entries of one segment value above which it is dealt out in blocks of about this size.
BLOCK = 1024
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text; 0 without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    joined = map(b" ".join, zip(*(words[i:] for i in range(k))))
    n = len(words) - k + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, n)
    rows = -(-n // 255)
    padded = np.zeros(rows * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(rows, 255)
    ones = np.empty(64, np.int64)
    for bit in range(8):  # eight byte lanes at a time; 255 ones fit a lane
        lanes = ((padded >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        ones[bit::8] = lanes.view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column | str, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.pandas_udf(LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts))
        give_back()
        return pd.Series(found.view(np.int64))

    return simhash(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def segment_plan(radius: int, segments: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment.

    With q, r = divmod(radius, segments), the first r + 1 segments take balls
    of radius q and the others q - 1 (none below 0): a pair beyond all of them
    differs in at least radius + 1 bits.
    """
    q, r = divmod(radius, segments)
    edges = [round(bits * i / segments) for i in range(segments + 1)]
    return [(lo, hi - lo, q if i <= r else q - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]


def chosen_segments(n: int, radius: int = RADIUS, among: tuple[int, ...] = SEGMENTS) -> int:
    """The number of segments with the fewest probes and chance meetings together for n fingerprints.

    A probe of a segment of w bits meets n / 2**w others by chance. So meetings, which
    grow as the square of n, are kept to about the probes by longer segments.
    """

    def cost(segments: int) -> float:
        probes = [(sum(math.comb(width, k) for k in range(ball + 1)), width) for _, width, ball in segment_plan(radius, segments) if ball >= 0]
        return sum(count * (1 + n / 2**width) for count, width in probes)

    return min(among, key=cost)


def _keys(radius: int, segments: int, balls: bool) -> Column:
    """Array of longs: the table's keys of a fingerprint `f`, or its probes' keys."""
    keys = []
    for i, (shift, width, ball) in enumerate(segment_plan(radius, segments)):
        if ball < 0:
            continue
        own = F.shiftrightunsigned("f", shift).bitwiseAND(F.lit((1 << width) - 1))
        flips = [sum(1 << b for b in bs) for n in range(ball + 1 if balls else 1) for bs in combinations(range(width), n)]
        keys += [own.bitwiseXOR(F.lit(x | i << 56)) for x in flips]
    return F.array(*keys)


def forest(q: np.ndarray, t: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the links within `radius` between q and t connect, at most one for each entry."""
    q, t = np.unique(q), np.unique(t)
    sides = (q, t)
    open_ = (np.ones(len(q), bool), np.ones(len(t), bool))
    a, b = [], []
    for start in range(len(q)):
        if not open_[0][start]:
            continue
        open_[0][start] = False
        front = [(0, start)]
        while front:
            side, i = front.pop()
            value, other = sides[side][i], 1 - side
            hit = np.flatnonzero(open_[other] & (np.bitwise_count(sides[other] ^ value) <= radius))
            open_[other][hit] = False
            front += [(other, j) for j in hit]
            a.append(np.full(len(hit), value))
            b.append(sides[other][hit])
    a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (a, b))
    return a[a != b], b[a != b]


def hamming_links(fingerprints: DataFrame, radius: int = RADIUS, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough for exact components.

    fingerprints: one column `f` (long), each value once, no nulls; segments: as
    chosen_segments, unless given. Segment
    values with up to `block` entries give every pair within `radius`. The
    others are cut into blocks of entries and of probes; each pair of blocks is
    one bounded group that returns a spanning forest of its links, so rows
    grow with the entries and not with the pairs.
    """
    if segments is None:
        segments = chosen_segments(fingerprints.count(), radius)
    table = fingerprints.select(F.explode(_keys(radius, segments, False)).alias("k"), F.col("f").alias("t"))
    probes = fingerprints.select(F.explode(_keys(radius, segments, True)).alias("k"), "f")
    hot = cut(table.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot")
    cold = table.join(hot, "k", "left_anti") if not hot.isEmpty() else table
    near = (F.col("f") < F.col("t")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("t"))) <= radius)
    links = probes.join(cold, (probes.k == cold.k) & near).select(F.col("f").alias("a"), F.col("t").alias("b"))
    if hot.isEmpty():
        return links
    asked = probes.join(hot, "k")
    many = hot.join(asked.groupBy("k").agg(F.count("*").alias("m")), "k").select("k", F.ceil(F.col("n") / block).alias("bt"), F.ceil(F.col("m") / block).alias("bq"))
    deal = lambda df, c, own, other: df.join(many, "k").select("k", F.pmod(F.xxhash64(c), own).alias(f"own_{own}"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"own_{other}"), F.col(c).alias("x"), F.lit(own == "bq").alias("probe"))
    blocks = deal(probes, "f", "bq", "bt").unionByName(deal(table, "t", "bt", "bq"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x, probe = pdf["x"].to_numpy().view(np.uint64), pdf["probe"].to_numpy()
        a, b = forest(x[probe], x[~probe], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return links.unionByName(blocks.groupBy("k", "own_bq", "own_bt").applyInPandas(link, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, segments: int | None = None, with_text_hash: bool = False) -> DataFrame:
    """(id_col, fingerprint long, component_id): every row with its component's smallest id; with_text_hash also text_hash, which tells rows of one id apart.

    Null, empty and word-less texts have fingerprint 0 and link with each other
    like any others. Equal fingerprints are one entry in the search, so exact
    copies cost one row; a repeated id keeps each of its rows. A null id is
    never a component's id unless its component has no other. Columns beyond
    the two named are not read. An empty table gives an empty table.
    """
    prints = cut(text_batches(docs).select(F.col(id_col), fingerprint_column(text_col, shingle_words).alias("f"), *([_text_hash(text_col)] if with_text_hash else [])), "simhash")
    first = cut(prints.groupBy("f").agg(F.min(id_col).alias("first_id")), "distinct")
    linked = components(hamming_links(first.select("f"), radius, segments))
    named = first.join(linked, first.f == linked.node, "left").select("f", "first_id", F.coalesce("component", "f").alias("c"))
    lowest = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    ids = named.join(lowest, "c").select(F.col("f").alias("print"), "component_id")
    return prints.join(ids, prints.f == ids.print).select(id_col, F.col("f").alias("fingerprint"), "component_id", *(["text_hash"] if with_text_hash else []))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, with their own columns, whose id is their component's smallest.

    Each row is judged by its own text, so a row stays whatever another with its
    id is like. Rows with a null id are kept. Of rows that repeat the smallest id
    all are kept.
    """
    found = near_duplicates(docs, id_col, text_col, with_text_hash=True, **settings)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_gone"), F.col("text_hash").alias("_gone_text")).distinct()
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (_text_hash(text_col) == gone["_gone_text"]), "left_anti")
