"""Alignment of two tokenizers' tokens, and how common each linked pair of ids is.

Where a token of A and one of B end at the same byte, both sequences are cut
into groups; within a group every A token is linked with every B token. A first
pass over the documents counts in each task how many of them hold a pair. The
distinct pairs get a minimal perfect hash, and the tasks' counts become dense
vectors indexed by it, which are summed in a tree. A second pass aligns the
documents again and looks the counts of their links up.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardfile.llm.mphf import MinimalHash, build, shard_of
from cardfile.llm.tokens import byte_letters
from cardfile.llm.workers import give_back
from cardfile.sources.store import cut, text_batches

A_TOKENIZER = "byte_bpe_50k.json"
B_TOKENIZER = "piece_bpe_32k.model"
#: Words whose alignment a Python worker keeps at hand, and distinct pairs that it counts before it sends them on.
MEMO = 400_000
HELD_PAIRS = 1 << 21
#: Distinct pairs of one shard of the hash.
SHARD_PAIRS = 1 << 15
#: At most so many pairs (12 bytes each) are broadcast at a time; more are taken in several rounds over the documents.
RESIDENT_PAIRS = 1 << 23
#: Counts of a dense vector that travel together, and vectors summed at a time.
BLOCK = 1 << 13
FAN_IN = 16
_LOADED: dict[tuple[str, str], Aligner] = {}


def load(a: str = A_TOKENIZER, b: str = B_TOKENIZER) -> Aligner:
    """This process's aligner; a and b are files' paths or names of public tokenizers' files."""
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Aligner(a, b)
    return _LOADED[a, b]


def _path(name: str) -> str:
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: str) -> list[str] | None:
    """The words of space + text, each with the space or line end before it, or None if other white space or the piece model's own space sign is in it."""
    parts = text.split()
    gaps = len(parts) - 1
    if not parts or "▁" in text or text.count(" ") + text.count("\n") != gaps or sum(map(len, parts)) + gaps != len(text):
        return None
    return text.replace("\n", " \n").split(" ")


def groups(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> list[tuple[list[int], list[int]]]:
    """The ids of each group, in order; both sequences stand for the same bytes."""
    out, j, end_a, end_b, own, other = [], 0, 0, 0, [], []
    for x in a:
        own.append(x)
        end_a += len(a_bytes[x])
        while end_b < end_a:
            other.append(b[j])
            end_b += len(b_bytes[b[j]])
            j += 1
        if end_a == end_b:
            out.append((own, other))
            own, other = [], []
    return out


def as_text(found: list[tuple[list[int], list[int]]]) -> str:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in found)


class Aligner:
    """Aligns whole texts by their words, with a memo.

    Neither tokenizer joins signs across a lone space or line end: A cuts there
    before it merges, and no piece of B has a space sign within it or a line end. So a
    text's groups are its words' groups; texts with other white space are taken whole.
    The words that are new in some texts are encoded together, as one text and as one
    list, and cut into groups by array operations.
    """

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_path(a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(b))
        letters = {letter: byte for byte, letter in byte_letters().items()}
        n = self.a.get_vocab_size()
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in map(self.a.id_to_token, range(n))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        self.lone = self.b.piece_to_id("▁")
        self.by_word = not any(("▁" in p[1:] and p.strip("▁")) or "\n" in p for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.shift = (len(pieces) - 1).bit_length()
        #: An id with what follows it: a comma or the end of a group's A side, a comma or the end of the group.
        self.signs = np.array([f"{i}{sign}" for of, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for sign in signs for i in range(len(of))], object)
        self.ranked = self._ranked()
        self.forget()

    def _ranked(self):
        """The vocabulary of A for tiktoken, which merges by rank: only if ids are in the order of the merges and it cuts texts alike."""
        spec = json.loads(self.a.to_str())
        merges = [self.a.token_to_id("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"].get("merges", [])]
        before = spec["pre_tokenizer"] or {}
        if merges != list(range(256, 256 + len(merges))) or spec["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex"):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        return self.ranked.encode_ordinary(text) if self.ranked else self.a.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.words: list[str] = []
        self.texts: list[str] = []
        self.seen = np.empty(0, np.int64)  # texts that a word was in
        self.sizes = np.empty((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.codes, self.times = np.empty(0, np.int64), np.empty(0, np.int64)  # of all words, one after another
        self.ends = np.zeros(1, np.int64)
        self.counted, self.looked = None, np.empty((0, 2), np.int64)

    def trim(self) -> None:
        """Keeps the words that were in most texts, at most half of the memo, and none that was in one only."""
        keep = np.sort(np.argsort(-self.seen, kind="stable")[: MEMO // 2])
        keep = keep[self.seen[keep] > 1]
        sizes = self.ends[keep + 1] - self.ends[keep]
        at = self._places(keep)
        self.codes, self.times, self.ends = self.codes[at], self.times[at], np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        self.looked = self.looked[keep[keep < len(self.looked)]]
        self.sizes, self.seen = self.sizes[keep], self.seen[keep] // 2
        self.words, self.texts = [self.words[i] for i in keep.tolist()], [self.texts[i] for i in keep.tolist()]
        self.memo = dict(zip(self.words, range(len(self.words))))

    def entry(self, text: str, a: list[int], b: list[int]) -> tuple:
        """(groups as text, (n_a, n_b, n_groups, n_links), distinct codes, their links, whether both stand for text's bytes)."""
        whole = text.encode()
        if b"".join([self.a_bytes[x] for x in a]) != whole or b"".join([self.b_bytes[x] for x in b]) != whole:
            none = np.empty(0, np.int64)
            return "", (0, 0, 0, 0), none, none, False
        found = groups(a, b, self.a_bytes, self.b_bytes)
        links: Counter[int] = Counter()
        for own, other in found:
            times = Counter(other).items()
            for x, n in Counter(own).items():
                for y, m in times:
                    links[x << self.shift | y] += n * m
        sizes = len(a), len(b), len(found), sum(links.values())
        return as_text(found), sizes, np.fromiter(links, np.int64, len(links)), np.fromiter(links.values(), np.int64, len(links)), True

    def whole(self, text: str) -> tuple:
        """The entry of a text that is not taken by words."""
        return self.entry(" " + text, self.encode_a(" " + text), self.b.encode(text))

    def learn(self, new: list[str]) -> None:
        """Puts words, with what stands before them, into the memo."""
        shown = [w if w[0] == "\n" else " " + w for w in new]
        joined = "".join(shown)
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, shown)), np.int64, len(shown)))
        own = np.array(self.encode_a(joined), np.int64)
        parts = [b[1:] if w[0] == "\n" else b for w, b in zip(new, self.b.encode(new, num_threads=1))]  # a line's space is not in the text
        other = np.fromiter(chain.from_iterable(parts), np.int64, sum(map(len, parts)))
        if b"".join(map(self.b_bytes.__getitem__, other.tolist())) != joined.encode():
            raise ValueError("words that the piece model does not give back")
        own_ends, other_ends = np.cumsum(self.a_sizes[own]), np.cumsum(self.b_sizes[other])
        common = np.zeros(len(joined.encode()) + 1, bool)
        common[own_ends] = True
        other_last = common[other_ends]
        cuts = other_ends[other_last]
        common[:] = False
        common[cuts] = True
        own_last = common[own_ends]
        own_group, other_group = np.cumsum(own_last) - own_last, np.cumsum(other_last) - other_last
        n_own, n_other = np.bincount(own_group, minlength=len(cuts)), np.bincount(other_group, minlength=len(cuts))
        word = np.searchsorted(ends, cuts)
        per_word = lambda values: np.bincount(word, values, len(new)).astype(np.int64)
        sizes = np.stack([per_word(n_own), per_word(n_other), per_word(None), per_word(n_own * n_other)], axis=1)
        # all pairs of each group: every A token with the group's B tokens
        many = n_other[own_group]
        first = (np.cumsum(n_other) - n_other)[own_group]
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        codes = np.repeat(own, many) << self.shift | other[at]
        keyed, times = np.unique(np.repeat(word[own_group], many) << 40 | codes, return_counts=True)
        counts = np.bincount(keyed >> 40, minlength=len(new))
        # a group's text: its A ids, then its B ids
        before = np.cumsum(n_other) - n_other
        place = np.empty(len(own) + len(other), np.int64)
        place[np.arange(len(own)) + before[own_group]] = own + own_last * len(self.a_bytes)
        place[np.arange(len(other)) + np.cumsum(n_own)[other_group]] = 2 * len(self.a_bytes) + other + other_last * len(self.b_bytes)
        signs, stops = self.signs[place].tolist(), np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()
        self.memo.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
        self.words += new
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.texts += ["".join(signs[i:j]) for i, j in zip([0, *stops], stops)]
        self.sizes = np.concatenate([self.sizes, sizes])
        self.codes = np.concatenate([self.codes, keyed & ((1 << 40) - 1)])
        self.times = np.concatenate([self.times, times])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def codes_of(self, which: np.ndarray) -> np.ndarray:
        """The codes of these words, one after another."""
        return self.codes[self._places(which)]

    def _places(self, which: np.ndarray) -> np.ndarray:
        sizes = self.ends[which + 1] - self.ends[which]
        return np.repeat(self.ends[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def known(self, texts: list[str]) -> list[np.ndarray | None]:
        """The numbers of each text's words, all of them in the memo; None of one that is to be taken whole or is empty."""
        split = [words(t) if self.by_word else None for t in texts]
        if len(self.memo) > MEMO:
            self.trim()
        new = set().union(*(s for s in split if s)).difference(self.memo)
        if new:
            self.learn(list(new))
        number = self.memo.__getitem__
        found = [np.fromiter(map(number, s), np.int64, len(s)) if s else None for s in split]
        for own in found:
            if own is not None:
                self.seen[own] += 1
        return found

    def links_of(self, counted: Counted) -> np.ndarray:
        """(n_best, count_sum) of all words in the memo; those of words seen before are at hand."""
        if self.counted != counted.name:
            self.counted, self.looked = counted.name, np.empty((0, 2), np.int64)
        have = len(self.looked)
        if have < len(self.texts):
            start = self.ends[have]
            self.looked = np.concatenate([self.looked, counted.of(self.codes[start:], self.times[start:], self.ends[have:] - start)])
        return self.looked


def _parts(texts: pd.Series, size: int = 1000) -> Iterator[list[str]]:
    for at in range(0, len(texts), size):
        yield [t or "" for t in texts.iloc[at : at + size]]


def pair_counts(docs: DataFrame, text_col: str = "text", a: str = A_TOKENIZER, b: str = B_TOKENIZER) -> DataFrame:
    """(codes, counts): of each task's documents, how many hold each linked pair; code = A id << shift | B id."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = load(a, b)
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting, size = [], 0

        def folded() -> None:
            """Adds what waits to the counts."""
            nonlocal codes, counts, size
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            codes = both
            waiting.clear()
            size = 0

        for pdf in batches:
            for texts in _parts(pdf["text"]):
                for text, found in zip(texts, aligner.known(texts)):
                    if found is not None:
                        at = np.unique(aligner.codes_of(np.unique(found)))
                    elif text:
                        at = aligner.whole(text)[2]
                    else:
                        continue
                    waiting.append(at)
                    size += len(at)
                if size > HELD_PAIRS:
                    folded()
                    if len(codes) > HELD_PAIRS:
                        yield pd.DataFrame({"codes": [codes], "counts": [counts]})
                        codes, counts = codes[:0], counts[:0]
        if waiting:
            folded()
        if len(codes):
            yield pd.DataFrame({"codes": [codes], "counts": [counts]})
        give_back()

    return text_batches(docs).select(F.col(text_col).alias("text")).mapInPandas(count, "codes array<long>, counts array<long>")


def hashed(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, sizes, bits, codes): the minimal perfect hash of the distinct codes in the column `code`."""

    @F.pandas_udf("int")
    def dealt(codes: pd.Series) -> pd.Series:
        return pd.Series(shard_of(codes.to_numpy(np.int64).astype(np.uint64), shards).astype(np.int32))

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, codes = build(pdf["code"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "sizes": [sizes], "bits": [bits], "codes": [codes.astype("<u8").tobytes()]})

    return pairs.withColumn("shard", dealt("code")).groupBy("shard").applyInPandas(built, "shard int, sizes array<long>, bits binary, codes binary")


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest takes."""
    return counts.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if counts.max() <= np.iinfo(t).max)).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // BLOCK}").astype(np.int64)


def summed(partials: DataFrame, table, fan_in: int = FAN_IN) -> np.ndarray:
    """The counts of all tasks by the index of the broadcast hash: dense vectors in blocks, summed `fan_in` at a time."""
    n = len(table.value)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vector = np.zeros(-(-n // BLOCK) * BLOCK, np.int64)
        for pdf in batches:
            for codes, counts in zip(pdf["codes"], pdf["counts"]):
                at = table.value.index(np.asarray(codes, np.int64).astype(np.uint64))
                vector[at[at >= 0]] += np.asarray(counts, np.int64)[at >= 0]
        part = TaskContext.get().partitionId()
        for i, block in enumerate(vector.reshape(-1, BLOCK)):
            if block.any():
                yield pd.DataFrame({"block": [i], "part": [part], "counts": [_narrow(block)]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(map(_wide, pdf["counts"]))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1] // fan_in, "counts": [_narrow(total)]})

    schema = "block long, part long, counts binary"
    vectors = cut(partials.mapInPandas(dense, schema), "vectors")
    parts = (vectors.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        vectors = vectors.groupBy("block", F.expr(f"part div {fan_in}").alias("_up")).applyInPandas(lambda key, pdf: added(pdf), schema)
        parts = -(-parts // fan_in)
    out = np.zeros(-(-n // BLOCK) * BLOCK, np.int64)
    for block, counts in vectors.select("block", "counts").toLocalIterator():
        out[block * BLOCK : (block + 1) * BLOCK] = _wide(bytes(counts))
    return out[:n]


class Counted:
    """Document counts of pairs, in memory for a range of the hash's shards."""

    def __init__(self, table: MinimalHash, counts: np.ndarray, most: np.ndarray, shift: int):
        self.table, self.counts, self.name = table, counts, uuid.uuid4().hex
        self.best = counts == most[(table.codes >> np.uint64(shift)).astype(np.int64)] if len(counts) else np.empty(0, bool)

    def of(self, codes: np.ndarray, times: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For the codes between each two ends a row: links whose count is the highest of their A id, sum of counts over links."""
        if not len(self.counts):
            return np.zeros((len(ends) - 1, 2), np.int64)
        at = self.table.index(codes.astype(np.uint64))
        links = times * (at >= 0)
        at[at < 0] = 0
        sums = np.zeros((len(codes) + 1, 2), np.int64)
        np.cumsum(links * self.best[at], out=sums[1:, 0])
        np.cumsum(links * self.counts[at], out=sums[1:, 1])
        return sums[ends[1:]] - sums[ends[:-1]]


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A_TOKENIZER, b: str = B_TOKENIZER, with_groups: bool = False, resident_pairs: int = RESIDENT_PAIRS, shard_pairs: int = SHARD_PAIRS, fan_in: int = FAN_IN) -> DataFrame:
    """Per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with_groups the groups as text.

    A encodes space + text, B the text, whose space it adds; strings of special
    tokens are plain text. Links are all pairs of an A and a B token of one group; a
    pair's count is the number of rows of docs that hold it. n_best counts the links
    whose count is their A id's highest, ties included; count_sum adds the counts
    of all links. A null or empty text, and one that either tokenizer doesn't
    give back byte by byte, has no tokens: zeros, and an empty groups_sha256.
    Repeated rows count each and keep each their row. An empty table gives an
    empty table. Other columns are not read.

    What is broadcast is checked: of more than resident_pairs distinct pairs
    a round over the documents takes as many shards as that allows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    partials = cut(pair_counts(docs, text_col, a, b), "pairs")
    pairs = cut(partials.select(F.explode("codes").alias("code")).distinct(), "distinct")
    n = pairs.count()
    shards = max(1, -(-n // shard_pairs))
    built = cut(hashed(pairs, shards), "hash")
    per_round = max(1, resident_pairs // shard_pairs)
    starts = range(0, shards, per_round)
    own = load(a, b)
    shift, most = own.shift, np.zeros(len(own.a_bytes), np.int64)

    def resident(start: int) -> MinimalHash:
        found = built.where(F.col("shard").between(start, start + per_round - 1)).collect()
        by_shard = {r["shard"]: (list(r["sizes"]), bytes(r["bits"]), np.frombuffer(r["codes"], "<u8")) for r in found}
        none = ([], b"", np.empty(0, np.uint64))
        return MinimalHash([by_shard.get(i, none) for i in range(start, min(start + per_round, shards))], shards, start)

    counts: list[bytes] = []
    for start in starts:
        table = resident(start)
        found = summed(partials, spark.sparkContext.broadcast(table), fan_in)
        np.maximum.at(most, (table.codes >> np.uint64(shift)).astype(np.int64), found)
        counts.append(found.astype("<u8").tobytes())
    many = len(starts) > 1
    if many:  # the same rows come again in every round
        rows = cut(rows, "rows")
    looked = [_looked_up(rows, spark.sparkContext.broadcast(Counted(resident(start), np.frombuffer(c, "<u8").astype(np.int64), most, shift)), a, b, with_groups and i == 0) for i, (start, c) in enumerate(zip(starts, counts))]
    out = looked[0]
    if many:
        rest = looked[1].select("row", "n_best", "count_sum")
        for other in looked[2:]:
            rest = rest.unionByName(other.select("row", "n_best", "count_sum"))
        more = rest.groupBy("row").agg(F.sum("n_best").alias("_best"), F.sum("count_sum").alias("_sum"))
        out = out.join(more, "row").withColumn("n_best", F.col("n_best") + F.col("_best")).withColumn("count_sum", F.col("count_sum") + F.col("_sum"))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *columns)


def _looked_up(rows: DataFrame, counted, a: str, b: str, with_groups: bool) -> DataFrame:
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, counts = load(a, b), counted.value
        for pdf in batches:
            out = []
            for texts in _parts(pdf["text"]):
                known = aligner.known(texts)
                links, shown_of = aligner.links_of(counts), aligner.texts.__getitem__
                for text, found in zip(texts, known):
                    numbers, shown = (0,) * 6, ""
                    if found is not None:
                        numbers = (*aligner.sizes[found].sum(axis=0).tolist(), *links[found].sum(axis=0).tolist())
                        shown = "".join(map(shown_of, found.tolist()))[:-1]
                    elif text:
                        shown, sizes, codes, times, _ = aligner.whole(text)
                        numbers = (*sizes, *counts.of(codes, times, np.array([0, len(codes)]))[0].tolist())
                    out.append((*numbers, hashlib.sha256(shown.encode()).hexdigest() if shown else "", shown if with_groups else None))
            made = pd.DataFrame(out, columns=names[2:])
            made.insert(0, "row", pdf["row"].to_numpy())
            made.insert(1, "id", pdf["id"].to_numpy())
            yield made
        give_back()

    return text_batches(rows).mapInPandas(look, "row long, id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
