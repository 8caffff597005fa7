"""The alignment against whole texts encoded and counted in plain Python, and the minimal perfect hash on its own."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from cardfile.llm import align, mphf

TEXTS = [
    None, "", " ", "a", "Hello world, tokens line up.", "Hello world, tokens line up.", "two  spaces\tand\ttabs\r\n", "line\nends\n\nhere", " leads", "trails ", "sign ▁ of the pieces", "naïve café 😀 日本語テキスト",
    "<|endoftext|> and <s> </s> <0x0A> are plain", "x" * 3000, "ſtrange Ⅷ ﬁ", "a b c d", "don't we'll I'd 12345 67,890.12", "zero\0byte", "word " * 4000 + "end", "\n", "-" * 300 + " " + "=" * 77,
]


def _expected(texts):
    """Straight from the definition: whole texts, byte offsets, all pairs of each group."""
    one = align.Aligner(align.A_TOKENIZER, align.B_TOKENIZER)
    rows, count = [], Counter()
    for text in texts:
        whole = b" " + (text or "").encode()
        a, b = one.a.encode(" " + (text or ""), add_special_tokens=False).ids, one.b.encode(text or "")
        if not text or b"".join(one.a_bytes[x] for x in a) != whole or b"".join(one.b_bytes[x] for x in b) != whole:
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(one.a_bytes[x]) for x in a]), np.cumsum([len(one.b_bytes[x]) for x in b])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        found, i, j = [], 0, 0
        for c in cuts:
            u, v = int(np.searchsorted(ends_a, c)) + 1, int(np.searchsorted(ends_b, c)) + 1
            found.append((a[i:u], b[j:v]))
            i, j = u, v
        links = [(x, y) for own, other in found for x in own for y in other]
        count.update(set(links))
        rows.append((len(a), len(b), found, links))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, found, links = row
        shown = ";".join(",".join(map(str, own)) + "|" + ",".join(map(str, other)) for own, other in found)
        out.append((n_a, n_b, len(found), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _got(docs, **settings):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in align.aligned(docs, **settings).collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"resident_pairs": 64, "shard_pairs": 32, "fan_in": 2}])
def test_odd_texts(spark, settings):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[4], "y"), (None, TEXTS[5], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5)
    expected = [(i is not None, i or 0, *e) for (i, _, _), e in zip(rows, _expected([t for _, t, _ in rows]))]
    assert _got(docs, **settings) == sorted(expected, key=str)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    expected = [(True, r["doc_id"], *e) for r, e in zip(rows, _expected([r["text"] for r in rows]))]
    assert _got(docs) == sorted(expected, key=str)


def test_no_rows_and_groups_as_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(none).collect() == []
    row = align.aligned(spark.createDataFrame([(1, "Hello wörld")], "doc_id long, text string"), with_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and row["n_links"] >= row["n_groups"] == row["groups"].count("|")


def test_both_ways_to_encode(spark, sf_dir):
    """The ranked vocabulary and the tokenizer's file give the same ids."""
    one = align.Aligner(align.A_TOKENIZER, align.B_TOKENIZER)
    texts = [t for t in TEXTS if t] + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).collect()]
    assert one.ranked and all(one.encode_a(" " + t) == one.a.encode(" " + t, add_special_tokens=False).ids for t in texts)


def test_forgetting_changes_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()
    one = align.Aligner(align.A_TOKENIZER, align.B_TOKENIZER)
    monkeypatch.setattr(align, "MEMO", 50)
    for at in range(0, 60, 6):
        texts = [r["text"] for r in docs[at : at + 6]]
        for text, found in zip(texts, one.known(texts)):
            shown = "".join(one.texts[w] for w in found)[:-1] if found is not None else one.whole(text)[0]
            assert shown == align.as_text(align.groups(one.a.encode(" " + text, add_special_tokens=False).ids, one.b.encode(text), one.a_bytes, one.b_bytes))


@pytest.mark.parametrize(("n", "shards"), [(0, 1), (1, 1), (5, 3), (20_000, 7)])
def test_hash_is_minimal_and_perfect(n, shards):
    codes = np.unique(np.random.default_rng(n).integers(0, 1 << 31, n).astype(np.uint64))
    dealt = mphf.shard_of(codes, shards)
    table = mphf.MinimalHash([mphf.build(codes[dealt == i]) for i in range(shards)], shards)
    at = table.index(codes)
    assert sorted(at.tolist()) == list(range(len(codes))) and (table.codes[at] == codes).all()
    assert (table.index(codes + np.uint64(1 << 40)) == -1).all()
