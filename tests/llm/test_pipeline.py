"""The pipeline over a whole small table: each stage against what it has to do to its own input."""

import re

import numpy as np

import corpus_pipeline
from cardfile.llm import pii, quality, queries
from cardfile.sources.store import cut


def test_stages_do_their_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        tables[name] = (docs, docs := cut(stage(spark, docs, sf_dir), name))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert all(out.columns == before.columns for before, out in list(tables.values())[:-1])
    rows = {n: (before.toPandas(), out.toPandas()) for n, (before, out) in tables.items()}

    before, out = rows["quality"]
    scored = queries.op9_quality(spark, sf_dir).toPandas()
    assert set(out.doc_id) == set(scored.doc_id[scored.score >= quality.THRESHOLD]) and 0 < len(out) < len(before)

    before, out = rows["near_duplicates"]
    from cardfile.llm.simhash import fingerprint

    prints = {i: fingerprint(t.encode()) for i, t in zip(before.doc_id, before.text)}
    ids = sorted(prints)
    root = {i: i for i in ids}
    near = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 4]
    for _ in ids:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(out.doc_id) == [i for i in ids if root[i] == i]

    before, out = rows["decontamination"]
    found = queries.op8_decontaminate(spark, sf_dir).toPandas()
    assert set(out.doc_id) == set(before.doc_id) - set(found.doc_id[found.contaminated])

    before, out = rows["personal_data"]
    old, new = before.set_index("doc_id").text, out.set_index("doc_id").text
    assert sorted(old.index) == sorted(new.index)
    for i, text in old.items():
        spans = pii.base_spans(text)
        assert (new[i] == text) if not spans else not any(text[a:b] in new[i] for _, a, b in spans if b - a > 6)
        assert set(re.findall(r"\w+", new[i])) <= set(re.findall(r"\w+", text)) | {"EMAIL", "IP", "CARD", "PHONE", "TERM"}

    before, out = rows["packing"]
    spread = out.sort_values(["doc_id", "start"])
    assert set(spread.doc_id) == set(before.doc_id)
    for _, own in spread.groupby("doc_id"):
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()] and own.length.sum() == own.doc_tokens.iloc[0]
    windows = spread.groupby("sequence_id").length.sum()
    assert all(n & (n - 1) == 0 and n <= 2048 for n in windows)


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 100 and {"doc_id", "start", "length", "ids", "tier"} <= set(rows.columns)
