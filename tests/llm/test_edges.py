"""Odd tables: nulls, empty and very long texts, ties, repeated rows, no rows, clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cardfile.llm import decontaminate, images, langid, pack, paragraphs, pii, quality, records, shards, simhash
from cardfile.sources.store import new_path

LONG = "lorem ipsum dolor sit amet " * 20_000
PARAGRAPH = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, ""), (2, None), (None, "one two three four five six"), (3, LONG), (4, "a b c"), (4, "a b c"), (5, "   \n\t "), (6, PARAGRAPH), (7, "x\n" + PARAGRAPH + "\ny"),
    (8, "Ünïcödé 漢字 🙂 " * 30), (9, "mail a.b@c.test and +1 (555) 123-4567"), (10, "one two three four five six"),
]
CLASHING = "row id f k t h a b score label stats print image bucket n m x word term entity told u v node component first_id shard slot curve _part _nth _at _start _all _found _stats _row _text part start nth at key ties found".split()


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, spark):
    return table(spark, ROWS if request.param == "odd" else []).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, None), (3, 1), (None, 1), (4, 1), (4, 0)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, PARAGRAPH), (4, PARAGRAPH), (4, PARAGRAPH)], "item_id long, text string")


def test_simhash(docs):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    if found:
        by = {r.doc_id: r for r in found}
        assert by[1].fingerprint == by[2].fingerprint == by[5].fingerprint == 0 and {by[i].component_id for i in (1, 2, 5)} == {1}
        assert by[10].component_id == by[None].component_id == 10
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == ([1, 3, 4, 4, 6, 7, 8, 9, 10] if found else [])


def test_images(spark, docs):
    rows = docs.select("doc_id", F.col("text").alias("html"), *CLASHING)
    found = images.image_copies(images.page_images(rows, "doc_id"), "doc_id").collect()
    assert len(found) == docs.count()
    if found:
        by = {r.doc_id: r for r in found}
        assert by[1].corners == 0 and by[1].class_id == by[2].class_id == 1 and by[10].class_id == by[None].class_id == 10
    ragged = spark.createDataFrame([(1, bytearray(b"abc"), 2), (2, bytearray(b"abcd"), None), (3, None, 5)], "image_id long, pixels binary, width int")
    assert {r.corners for r in images.image_copies(ragged).collect()} == {0}


def test_pii(docs):
    found = pii.found_spans(docs).collect()
    assert len(found) == docs.count()
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    if found:
        assert [tuple(s) for s in next(r for r in found if r.doc_id == 9).base] == [("email", 5, 15), ("phone", 20, 37)]
        assert clean.where("doc_id = 9").first().text == dict(r[:2] for r in ROWS)[9].replace("a.b@c.test", "[EMAIL]").replace("+1 (555) 123-4567", "[PHONE]")  # no term stands near a value in two texts
        assert clean.where("doc_id = 2").first().text is None and clean.first().row == "own row"


def test_records(spark, docs):
    path = new_path(spark, "test")
    records.write_records(docs, path, files=3)
    back = records.read_records(spark, path).collect()
    assert len(back) == docs.count() == records.read_shuffled(spark, path, 1).count()
    ids = [r.id for r in sorted(back, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)


def test_shards(docs):
    found = shards.hilbert_shards(docs, 5)
    assert set(found.columns) == set(docs.columns)
    counts = sorted(r["count"] for r in found.groupBy("shard").count().collect())
    assert sum(counts) == docs.count() and (not counts or counts[-1] - counts[0] <= 1)
    assert found.select("shard", "slot").distinct().count() == docs.count()


def test_packing(docs):
    pieces = pack.packed(docs).collect()
    whole = sum(r.length for r in pieces)
    assert whole == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert sum(r.start == 0 for r in pieces) == docs.count()


def test_language(docs):
    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy")))
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i in (1, 2, 5):
        assert not found or (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert found == {} or not {"own _found", "own row"} - set(next(iter(found.values())))
    assert langid.predict(docs, langid.fit(docs)).where("lang_pred <> 'und'").isEmpty()


def test_decontamination(docs, benchmark):
    found = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark).collect()}
    if found:
        assert (found[7].n_words, found[7].n_hit, found[7].items) == (62, 60, ["4"]) and found[10].n_hit == 3 and found[10].items == ["1"]
        assert found[1].n_words == found[2].n_words == 0 and found[3].n_hit == 0
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == (({r[0] for r in ROWS}) - {6, 7, 10} if found else set())
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0").isEmpty()


def test_quality(docs, labels):
    model = quality.fit(docs, labels)
    scores = quality.score(docs.select("doc_id", "text"), model)
    assert scores.count() == docs.count() and scores.where("score is null or score < 0 or score > 1").isEmpty()
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.fit(docs, labels.limit(0)).prior == 0


def test_paragraphs(docs):
    found = paragraphs.repeated_paragraphs(docs).collect()
    if found:
        assert {r.doc_id for r in found} == {6, 7} and all(r.removed == (r.doc_id == 7) and r.class_id == 6 for r in found)
        whole = {i: [(r.start, r.end, r.class_paragraph) for r in found if r.doc_id == i] for i in (6, 7)}
        assert len(whole[6]) == len(whole[7]) > 1


def test_stages_keep_columns(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, own, f"file://{tmp_path}").columns == own.columns


def test_rows_and_not_ids_are_judged(spark):
    """Another row with the same id decides nothing, in either filter."""
    a, b = "these words are said here and again in just this order every time " * 2, "nothing of the other text stands in this one at all, not even a bit of it"
    docs = spark.createDataFrame([(2, a, 1), (4, a, 2), (4, b, 3), (None, a, 4)], "doc_id long, text string, row int")
    assert {(r.doc_id, r.row) for r in simhash.keep_one(docs).collect()} == {(2, 1), (4, 3), (None, 4)}
    benchmark = spark.createDataFrame([("1", a)], "item_id string, text string")
    assert {(r.doc_id, r.row) for r in decontaminate.keep_clean(docs, benchmark).collect()} == {(4, 3), (None, 4)}


def test_stages_keep_clashing_columns(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    names = ["row", "id", "h", "f", "hash", "text_hash", "component_id", "fingerprint", "quality", "score", "spans", "base", "items", "n_words", "n_hit", "term", "kind", "print", "label", "item_id"]
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, own, f"file://{tmp_path}")
        assert kept.columns == own.columns and all(r[n] == n for r in kept.collect() for n in names)
