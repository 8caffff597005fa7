"""Hierarchical packing into windows of several context sizes.

Documents are routed to the shortest tier that holds what is left of them
beside whole windows of the longest. Each tier packs its own documents, one
after another; gaps that a whole shorter document fits are filled with one,
other gaps with the beginning of the tier's next document. All windows are
full, and steps take the same number of tokens.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardfile.llm import tokens
from cardfile.llm.workers import give_back
from cardfile.sources.store import text_batches

TIERS = (2048, 1024, 512, 256)
TOKENIZER = "word_bpe_49k.json"
END = 1
#: Tokens of a step group: of windows of one tier, or mixed ones at the end of a task, whose last group may have fewer.
STEP_TOKENS = 1 << 15
#: Tokens that are packed together at most (a longer document is packed alone).
CHUNK_TOKENS = 1 << 20


Piece = tuple[int, int, int]


def powers(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Windows of descending powers of two that hold these pieces in order."""
    windows, room, left = [], 0, sum(n for _, _, n in pieces)
    for d, start, n in pieces:
        while n:
            if not room:
                room = 1 << (left.bit_length() - 1)
                left -= room
                windows.append((room, []))
            part = min(room, n)
            windows[-1][1].append((d, start, part))
            start, n, room = start + part, n - part, room - part
    return windows


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows (size, [(document, start, length)]), and the pieces left over, fewer tokens than the shortest tier.

    Together they hold every token of documents of these lengths once. Every
    second document of a tier may fill gaps of longer ones; those not taken are
    packed with the rest of their tier. What does not fill a tier's last window
    goes to the next tier. With `last`, what is left fills windows of smaller
    powers of two.
    """
    top = tiers[0]
    windows = [(top, [(d, at, top)]) for d, n in enumerate(lengths) for at in range(0, n - top + 1, top)]
    own: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    fillers: list[tuple[int, int, int]] = []  # (length, document, start), shortest first
    for d, n in enumerate(lengths):
        if n % top:
            piece = (n % top, d, n - n % top)
            pool = own[min(t for t in tiers if t >= piece[0])]
            if pool is not own[top] and len(pool) % 2:
                insort(fillers, piece)
                pool.append(None)
            else:
                pool.append(piece)
    rest: list[Piece] = []
    for tier in tiers:
        shorter = max((t for t in tiers if t < tier), default=0)
        at = bisect_right(fillers, (shorter, len(lengths), 0))
        queue = deque((n, d, start) for d, start, n in rest)
        queue.extend(sorted((p for p in own[tier] if p), reverse=True))
        queue.extend(reversed(fillers[at:]))
        del fillers[at:]
        pieces, room = [], tier
        while queue:
            n, d, start = queue.popleft()
            part = min(n, room)
            pieces.append((d, start, part))
            room -= part
            if part < n:
                queue.appendleft((n - part, d, start + part))
            while room and (at := bisect_right(fillers, (room, len(lengths), 0))):
                n, d, start = fillers.pop(at - 1)
                pieces.append((d, start, n))
                room -= n
            if not room:
                windows.append((tier, pieces))
                pieces, room = [], tier
        rest = pieces
    return (windows + powers(rest), []) if last else (windows, rest)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece of a document: id_col, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset, tier, padded, step_group.

    A null text is empty and gives the end id alone; a null id stays null;
    repeated rows are packed each; very long texts are cut into windows of the
    longest tier. tier is the window's size, one of tiers (in a task's last
    group also a smaller power of two), and padded the length after padding, which is
    the same. A step_group is windows of step_tokens tokens in all: of one tier,
    at a task's end of several, and only its last one may have fewer. Each task
    packs its own rows, in chunks of bounded size whose left-over pieces go on to the
    next, so nothing is shuffled; the ids of sequences and groups carry the
    task's number. An empty table gives an empty table.
    """
    # ids pass through pandas as text: whole numbers with nulls would become floats
    rows = text_batches(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    names = ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "padded", "step_group")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.load(tokenizer)
        end = np.array([end_id], encoder.dtype)
        base = TaskContext.get().partitionId() << 36
        count = groups = size = 0
        held: list[tuple[object, np.ndarray, int, int]] = []  # id, token ids, their place in the document, its tokens
        waiting: dict[int, list[list[tuple]]] = {}  # windows of each size until they fill a step

        def group(windows: list[list[tuple]]) -> Iterator[tuple]:
            nonlocal groups
            for window in windows:
                yield from (row + (base + groups,) for row in window)
            groups += 1

        def close(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal count, size
            made: list[tuple] = []
            windows, rest = plan([len(ids) for _, ids, _, _ in held], tiers, last)
            for tier, pieces in windows:
                window, offset = [], 0
                for d, start, n in pieces:
                    key, ids, at, whole = held[d]
                    window.append((key, at + start, n, ids[start : start + n].astype("<u4").tobytes(), whole, base + count, offset, tier, tier))
                    offset += n
                count += 1
                same = waiting.setdefault(tier, [])
                same.append(window)
                if len(same) * tier >= step_tokens:
                    made.extend(group(same))
                    same.clear()
            held[:] = [(held[d][0], held[d][1][start : start + n], held[d][2] + start, held[d][3]) for d, start, n in rest]
            size = sum(len(ids) for _, ids, _, _ in held)
            if last:  # powers of two, largest first, fill each mixed step but the last
                mixed, taken = [], 0
                for tier in sorted(waiting, reverse=True):
                    for window in waiting[tier]:
                        mixed.append(window)
                        taken += tier
                        if taken >= step_tokens:
                            made.extend(group(mixed))
                            mixed, taken = [], 0
                made.extend(group(mixed))
            if made:
                yield pd.DataFrame(made, columns=names)

        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                for key, ids in zip(part["id"], encoder.encode(part["text"])):
                    held.append((key, np.concatenate((ids, end)), 0, len(ids) + 1))
                    size += len(ids) + 1
                    if size >= chunk_tokens:
                        yield from close(False)
        yield from close(True)
        give_back(encoders=True)

    made = rows.mapInPandas(pack, "id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, padded long, step_group long")
    return made.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *made.columns[1:])
