"""Repeated paragraphs against SQL over all pairs, and against all runs of 51 words that documents share."""

from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq

from cardfile.llm import paragraphs, queries


def sharing(rows, n):
    """(ids of documents with a run of n words that another one has, ids of those with one that stands in another place)."""
    where = defaultdict(list)
    for i, text in rows:
        words = text.encode().lower().split()
        for j in range(len(words) - n + 1):
            where[tuple(words[j : j + n])].append(i)
    repeated = [ids for ids in where.values() if len(ids) > 1]
    return set().union(*(ids for ids in repeated if len(set(ids)) > 1)), set().union(*repeated)


def test_query_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = queries.op10_paragraphs(spark, sf_dir)
    want = con.execute(queries.oracle_sql()["op10_paragraphs"]).df()[got.columns]
    assert len(want) > 100 and set(got.toPandas().itertuples(index=False, name=None)) == set(want.itertuples(index=False, name=None))


def test_documents_that_share_a_passage_are_found(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    want, may = sharing(zip(rows.doc_id, rows.text), 51)[0], sharing(zip(rows.doc_id, rows.text), 8)[1]
    found = {r.doc_id for r in queries.op10_paragraphs(spark, sf_dir).select("doc_id").collect()}
    assert len(want & found) >= 0.95 * len(want) and found <= may


def test_embedded_and_split_passages_are_found(spark):
    rng = np.random.default_rng(4)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passages = [own(60) for _ in range(30)]
    rows = []
    for k, passage in enumerate(passages):
        rows.append((3 * k, " ".join(own(300) + passage + own(80))))  # within a line
        rows.append((3 * k + 1, " ".join(own(40)) + "\n" + "\n".join(" ".join(passage[i : i + 7]).upper() for i in range(0, 60, 7))))  # over short lines
        rows.append((3 * k + 2, " ".join(own(200))))
    found = paragraphs.repeated_paragraphs(spark.createDataFrame([*rows, (None, None), (99, "")], "doc_id long, text string")).collect()
    ids = {r.doc_id for r in found}
    assert not any(i % 3 == 2 for i in ids) and sum(i % 3 == 0 for i in ids) >= 28 and sum(i % 3 == 1 for i in ids) >= 28
    text = dict(rows)
    for r in found:
        assert r.removed == (r.doc_id % 3 == 1) and len(text[r.doc_id][r.start : r.end].split()) == r.n_words and r.span_start <= r.start and r.end <= r.span_end


def test_edited_paragraphs_are_one_class(spark):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    edited = list(base)
    edited[200] = "changed"
    found = paragraphs.repeated_paragraphs(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited))], "doc_id long, text string"), rows_per_band=1).collect()
    assert sum(r.n_words for r in found if r.doc_id == 2) > 300 and all(r.class_id == 1 and r.class_size == 2 for r in found)


def test_values_of_words():
    words = paragraphs.words_of(" Ünï\n\tB ")
    assert words.starts.tolist() == [1, 6] and words.ends.tolist() == [4, 7] and len(words.hashes) == 2
    assert paragraphs.words_of("ünï b").values.tolist() == paragraphs.words_of("ünï B").values.tolist()
    assert paragraphs.words_of("\ud800 x").starts.tolist() == [0, 2] and not len(paragraphs.words_of(None).hashes)
