"""Sketches against plain sets of shingles."""

import hashlib

import numpy as np
import pytest

from cardfile.llm import sketch
from cardfile.llm.hashing import grams_of, word_hashes


def _shingles(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def _kept(shingles, fraction=sketch.FRACTION):
    hashes = {int(grams_of(word_hashes(s.split()), len(s.split()))[0]) for s in shingles}
    return sorted(h for h in hashes if h < fraction * 2**64) or sorted(hashes)[:1]


TEXTS = [None, "", "  \n", "one", "One", "a b c d", "a b c d e", "a b c d e", "é" * 7, "😀 x " * 40, "word " * 20_000, " ".join(map(str, range(3000)))]


def test_sketch_is_what_is_below_the_fraction():
    for text in TEXTS:
        assert sketch.sketch(text).tolist() == _kept(_shingles(text))
    assert len(sketch.sketch(TEXTS[-1])) == pytest.approx(2996 / 16, rel=0.25)
    parts = [sketch.sketch(t) for t in TEXTS]
    assert sketch.merged(parts).tolist() == _kept(set().union(*map(_shingles, TEXTS))) and not len(sketch.merged([]))


def test_containment_of_very_unequal_texts():
    long = " ".join(f"w{i}" for i in range(60_000))
    short = " ".join(f"w{i}" for i in range(1000, 3000)) + " " + " ".join(f"v{i}" for i in range(2000))
    a, b = sketch.sketch(short), sketch.sketch(long)
    assert sketch.containment(a, b) == pytest.approx(0.5, abs=0.1) and sketch.containment(b, a) < 0.05
    assert sketch.likeness(a, b) == sketch.likeness(b, a) == sketch.containment(a, b) and sketch.likeness(a, a) == 1
    none = sketch.sketch("")
    assert sketch.likeness(none, none) == 1 and sketch.likeness(none, a) == sketch.likeness(a, none) == 0


def _expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (key, text) in enumerate(rows):
        own, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(own) // 2
        changed = own[: len(own) - half] + following[:half]
        a, e, n = (sketch.sketch(t) for t in (own, changed, following))
        hexed = lambda s: s.astype("<u8").tobytes().hex()
        out.append((key, len(own), hashlib.sha256(changed.encode()).hexdigest(), hexed(a), hexed(e), sketch.likeness(a, e), sketch.likeness(a, n)))
    return sorted(out, key=str)


def _got(docs):
    found = sketch.compared_with_next(docs).withColumn("sketch", sketch.as_text("sketch")).withColumn("edited_sketch", sketch.as_text("edited_sketch"))
    return sorted(map(tuple, found.collect()), key=str)


def test_odd_rows(spark):
    rows = [(i * 3 % 12 if i else None, t) for i, t in enumerate(TEXTS)]
    rows = [(k, t) for k, t in {k: (k, t) for k, t in rows}.values()]  # ids once each
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, part int").repartition(3)
    assert _got(docs) == _expected(rows)
    assert _got(docs.limit(0)) == []
    assert _got(spark.createDataFrame([(5, "only one here")], "doc_id long, text string")) == _expected([(5, "only one here")])


def test_one_id_with_most_rows(spark):
    """Rows of one id in many ranges: each has one next row, and every text is next once."""
    docs = spark.createDataFrame([(7, f"text number {i} of this id " * 30) for i in range(300)] + [(1, "first"), (9, None)], "doc_id long, text string")
    found = sketch.compared_with_next(docs).collect()
    assert len(found) == 302 and sum(r["doc_id"] == 7 for r in found) == 300
    assert {r["edited_sha256"] for r in found if r["doc_id"] == 9} == {hashlib.sha256(b"").hexdigest()}


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = _got(docs)
    assert found == _expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert np.mean([r[5] for r in found]) > 0.4 > 0.1 > np.mean([r[6] for r in found])


def test_sketches_of_groups(spark):
    rows = [("a", "x y z w v u t s " * 3), ("a", "other words here are these few"), ("b", ""), ("c", "one"), (None, "a b c d e f g h i j k l m n o p q r s t u v w x y z")]
    docs = spark.createDataFrame(rows, "source string, text string").union(spark.createDataFrame(rows, "source string, text string"))
    found = sorted(map(tuple, sketch.sketch_rows(docs, "source").collect()), key=str)
    groups = {}
    for key, text in rows:
        groups.setdefault(key, set()).update(_shingles(text))
    assert found == sorted(((k, int(np.uint64(h).view(np.int64))) for k, s in groups.items() for h in _kept(s)), key=str)
