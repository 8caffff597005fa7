"""The trie against every prefix of every conversation in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import Row

from cardfile.llm import trie


def rebuilt(rows, every=20, most=4):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    said = {c: [(t[2], t[4]) for t in sorted(own)] for c, own in turns.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % most
        other = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = said.get(other, [])[:h] + own[h:]
    return out


def expected(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children, leaves, saved, out = defaultdict(int), defaultdict(int), defaultdict(int), []
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        here = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += here
            leaves[node[:d]] += node not in children
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **settings):
    table = spark.createDataFrame([Row(conv_id=c, turn=t, role=r, text=x, w="extra", k1=7) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, w string, k1 long")
    found = trie.prefix_trie(trie.with_common_starts(trie.ordered_turns(table)), **settings)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)


ODD = [
    (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 2, "user", "two  words"), (1, 5, "user", "a b c"), (2, 1, "user", "a b c"), (2, None, "user", "a b c"),
    (20, 1, "user", "hi there"), (21, 1, "user", "hi there"), (21, 2, "assistant", "hi there"), (22, 1, "assistant", "hi there"), (41, 1, "user", "of no other"), (43, 3, "user", "x"), (43, 2, "user", "y"),
    (-3, 1, "user", "below zero"), (-20, 1, "user", "one"), (-21, 1, "user", "two"), (None, 1, "user", "nobody's"), (60, 1, "user", "w " * 50_000), (61, 1, "user", "w " * 50_000),
]


def test_odd_rows(spark):
    assert got(spark, ODD) == expected(rebuilt(ODD))


def test_no_rows_and_turnless_ones(spark):
    assert got(spark, []) == []
    alone = [(c, 1, "user", "only turn") for c in (41, 43, 47) if zlib.crc32(str(c).encode()) % 4]  # without conversation 40 they lose it
    assert alone and got(spark, alone) == expected(rebuilt(alone))


@pytest.mark.parametrize(("seed", "batches", "growth"), [(1, 3, 4), (2, 5, 2)])
def test_chains_copies_and_long_conversations(spark, monkeypatch, seed, batches, growth):
    """Two texts make deep shared edges that are split again and again; blocks of four turns and of four ids."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    rng, rows = random.Random(seed), []
    for c in range(60):
        copied = rng.random() < 0.3
        size = 3 if copied else rng.choice([1, 2, 5, 9, 17, 40])
        rows += [(c, t, "user", "same" if copied or rng.random() < 0.85 else "other words") for t in range(size)]
    assert got(spark, rows, batches=batches, growth=growth) == expected(rebuilt(rows))


def test_fattest_number(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    found = spark.createDataFrame(pairs, "a long, b long").select("a", "b", trie.fattest("a", "b").alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x) for r in found)


def test_conversations_as_they_are(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = trie.ordered_turns(table)
    found = trie.prefix_trie(trie.plain(turns))
    said = defaultdict(list)
    for r in sorted(table.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        said[r["conv_id"]].append((r["role"], r["text"]))
    assert sorted(map(tuple, found.collect()), key=str) == expected(said)
