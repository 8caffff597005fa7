"""The registered queries of the training-data operators, and SQL where SQL can express them.

Each is a thin reading of its operator's result over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardfile.llm import align, decontaminate, images, langid, pack, paragraphs, pii, quality, records, shards, simhash, sketch, sql, trie
from cardfile.sources.store import new_path

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component's smallest doc_id."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, drawn as an image, with the class of the cropped or edited copies it belongs to."""
    return images.image_copies(images.page_images(_table(spark, sf_dir, "pages")), "page_id")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document, and of the terms that reveal it."""
    found = pii.found_spans(_table(spark, sf_dir, "documents"))
    kinds = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *kinds, F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as binary records, read back: where their ids start, how many, and their checksum."""
    path = new_path(spark, "records")
    records.write_records(_table(spark, sf_dir, "documents"), path)
    return records.read_records(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 runs of a Hilbert curve, with counts at most one apart."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shards.hilbert_shards(rows, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 256 to 2048 tokens."""
    pieces = pack.packed(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "padded", "step_group")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document occurs in benchmark items."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from four fifths of the labels."""
    docs, held = _table(spark, sf_dir, "documents"), quality.held_out()
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~held))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that repeats, in any lines, with its class, its span and whether it goes."""
    return paragraphs.repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens of every document line up, and how common the linked pairs of ids are."""
    return align.aligned(_table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch of every document and of its edited text, and how alike it, that and the next document are."""
    found = sketch.compared_with_next(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", sketch.as_text("sketch").alias("fingerprint"), sketch.as_text("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that begin like others."""
    turns = trie.ordered_turns(_table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.with_common_starts(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_image_copies, op3_pii, op4_records, op5_hilbert_shards, op6_packing, op7_language, op8_decontaminate, op9_quality, op10_paragraphs, op11_alignment, op12_fingerprints, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    """The others need hashes, tokenizers or fitted models that SQL has not; tests hold them against brute force."""
    p = paragraphs
    return {"op13_prefix_trie": sql.prefix_trie(), "op8_decontaminate": sql.decontaminate(decontaminate.SPAN), "op10_paragraphs": sql.repeated_paragraphs(p.MIN_WORDS, p.SPAN_WORDS, p.SHINGLE_WORDS, p.SIMILARITY, p.WINDOW, p.PRIME, p.CHARACTER_WEIGHTS, p.WORD_WEIGHTS)}
