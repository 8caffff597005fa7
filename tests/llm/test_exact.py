"""The registered results against brute force on the small tables."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from cardfile.llm import components, decontaminate, images, langid, pack, paragraphs, pii, quality, queries, records, shards, simhash, tokens, workers
from cardfile.sources.store import new_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas().sort_values("doc_id")
    return dict(zip(rows.doc_id, rows.text))


def result(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir).toPandas()


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [tuple(map(int, x)) for x in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = roots(2100, links)
    assert got == {x: want[x] for ab in links for x in ab if ab[0] != ab[1]}


def test_simhash_is_exact(spark, sf_dir, texts):
    df = result(spark, sf_dir, "op1_simhash").set_index("doc_id")

    def fingerprint(text):
        w = re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    ids = list(texts)
    prints = [fingerprint(texts[i]) for i in ids]
    assert [int(df.fingerprint[i], 16) for i in ids] == prints
    near = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert [df.component_id[i] for i in ids] == [ids[r] for r in roots(len(ids), near)]


@pytest.mark.parametrize("segments", [None, 2, 3, 4])
def test_hot_tables_link_as_all_pairs(spark, segments):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62)
    values = sorted({int(base) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(250)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "f long"), segments=segments, block=20).collect()
    at = {v: i for i, v in enumerate(signed)}
    assert all((values[at[x.a]] ^ values[at[x.b]]).bit_count() <= 4 for x in links)
    near = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 4]
    assert roots(len(values), [(at[x.a], at[x.b]) for x in links]) == roots(len(values), near)


@pytest.mark.parametrize(("radius", "segments"), [(4, 2), (4, 3), (4, 4), (3, 2), (6, 4)])
def test_balls_cover_the_radius(radius, segments):
    plan = simhash.segment_plan(radius, segments)
    assert sum(w for _, w, _ in plan) == 64 and sum(b + 1 for _, _, b in plan) == radius + 1


def test_segments_follow_the_count():
    assert [simhash.chosen_segments(10**k) for k in (2, 6, 9)] == [4, 3, 2]


def test_pii_base_is_exact(spark, sf_dir, texts):
    df = result(spark, sf_dir, "op3_pii").set_index("doc_id")
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def keeps(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
        return {"email": True, "ip": all(int(p) < 256 for p in match.split(".")) if kind == "ip" else None, "phone": 9 <= len(digits) <= 15}[kind]

    odd = ["a@b@c.d a..b@x-.y. @q.r", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111-1111 1111 4111111111111112 " + "0" * 40, "+1 (2).3-4 5678901 +12345678 + 1", "x" * 3000 + "@y.z"]
    for text in [*texts.values(), *odd]:
        want = [(k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, text) if keeps(k, m[0])]
        assert pii.base_spans(text) == want
    for i, text in texts.items():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text))
        assert df.base_sha256[i] == hashlib.sha256(base.encode()).hexdigest() and df.spans[i].startswith(base)


def test_workers_keep_encoders_for_steps_that_use_them():
    kept = tokens.load("word_bpe_49k.json")
    workers.give_back(encoders=True)
    assert tokens.load("word_bpe_49k.json") is kept
    workers.give_back()  # as any other step's tasks end
    assert tokens.load("word_bpe_49k.json") is not kept


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_tokenizers(texts, name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    odd = ["<|endoftext|>", "a <|startoftext|>b", "<|unk|> <|", "", " ", "a  b", "a\tb\n", "\n\nx", "İstanbul Σας naïve", "foo\x1cbar", "don't stop's", "x" * 50, "12 3.4", "<|endoftext|> hi", "日本語　x y", "tail ", "\0a b", None]
    for memo in (5, 100_000):
        own = tokens.Encoder(name, memo)
        for part in (list(texts.values())[:60], odd, odd):
            assert [x.tolist() for x in own.encode(part)] == [whole.encode(t or "", add_special_tokens=False).ids for t in part]


def test_records_come_back(spark, sf_dir, texts):
    df = result(spark, sf_dir, "op4_records").sort_values("doc_id")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts.values()]
    n = np.array([len(x) for x in ids])
    assert df.doc_id.tolist() == list(texts) and df.n_tokens.tolist() == n.tolist() and df.start.tolist() == (np.cumsum(n) - n).tolist()
    assert df.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_damaged_records_are_found():
    good = records.frame(7, np.arange(5, dtype="<u2")) + b"\n"
    assert records.unframe(good)[0] == 7 and records.unframe(good)[1].tolist() == list(range(5))
    for at in (0, 9, 14, 24, len(good) - 3):
        with pytest.raises(ValueError):
            records.unframe(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    with pytest.raises(ValueError):
        records.unframe(good[:-4])


def test_hilbert_curve_steps_to_neighbours():
    axes = [a.ravel() for a in np.meshgrid(*[np.arange(8)] * 3, indexing="ij")]
    index = shards.hilbert_index(axes, 3)
    order = np.argsort(index)
    assert sorted(index) == list(range(512))
    assert (sum(np.abs(np.diff(a[order])) for a in axes) == 1).all()


def test_shards_are_even(spark, sf_dir, texts):
    df = result(spark, sf_dir, "op5_hilbert_shards")
    sizes = df.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 24
    assert all(sorted(g) == list(range(len(g))) for _, g in df.groupby("shard").slot)
    assert {r.doc_id: (r.size_, r.text_crc32) for r in df.rename(columns={"size": "size_"}).itertuples()} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert df.sort_values(["shard", "slot"]).curve.is_monotonic_increasing


def test_packing_holds_each_id_once(spark, sf_dir, texts):
    df = result(spark, sf_dir, "op6_packing")
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = {i: whole.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    done = dict.fromkeys(left, 0)
    for r in df.sort_values(["doc_id", "start"]).itertuples():
        assert r.start == done[r.doc_id] and r.doc_tokens == len(left[r.doc_id])
        assert zlib.crc32(np.array(left[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        done[r.doc_id] += r.length
    assert done == {i: len(x) for i, x in left.items()}
    for _, g in df.sort_values("offset").groupby("sequence_id"):
        total = int(g.length.sum())
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and total <= 2048 and total & (total - 1) == 0


@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("lengths", [[], [1], [0], [2048], [5000, 3, 3, 700, 255, 256, 257], [1] * 100, list(range(1, 3000, 37)), [700, 300, 200, 100, 1500, 400, 900] * 30])
def test_packing_plan(lengths, last):
    windows, rest = pack.plan(lengths, last=last)
    held = sorted((d, s + i) for _, ps in [*windows, (0, rest)] for d, s, n in ps for i in range(n))
    assert held == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
    assert all(size == sum(n for _, _, n in ps) and size & (size - 1) == 0 for size, ps in windows)
    assert sum(n for _, _, n in rest) < 256 and (last or all(size in pack.TIERS for size, _ in windows))


def test_tiers_hold_documents_of_their_length_and_steps_are_equal(spark, sf_dir):
    df = pack.packed(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(1), step_tokens=1 << 12, chunk_tokens=1 << 15).drop("ids").toPandas()
    windows = df.groupby("sequence_id").agg(tier=("tier", "first"), step=("step_group", "first"), pieces=("length", "size"))
    counts = windows.tier.value_counts()
    assert all(counts[t] >= 5 for t in pack.TIERS) and counts[[t for t in counts.index if t < 256]].sum() <= 8
    sizes = windows.groupby("step").tier.sum().sort_index()
    assert (sizes[:-1] == 1 << 12).all() and sizes.iloc[-1] <= 1 << 12 and len(sizes) > 20
    short = df[(df.start == 0) & (df.length == df.doc_tokens) & (df.doc_tokens <= 512)].tier
    assert (short > 512).sum() > 0 and (short <= 512).sum() > 0  # some fill gaps of longer windows, some stay in their tier


def test_language_of_held_out_documents(spark, sf_dir):
    df = result(spark, sf_dir, "op7_language").merge(pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()[["doc_id", "lang"]], on="doc_id")
    held = df[df.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and (held.lang == held.lang_pred).mean() > 0.97
    assert df.score.between(0, 1).all()


def test_decontamination_is_exact(spark, sf_dir, texts):
    df = result(spark, sf_dir, "op8_decontaminate").set_index("doc_id")
    bench = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pandas()
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for item, text in zip(bench.item_id, bench.text):
        w = word.findall(text.translate(LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    for i, text in texts.items():
        w = word.findall(text.translate(LOWER))
        hit, items = set(), set()
        for n in set(map(len, windows)):
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    items |= windows[tuple(w[j : j + n])]
        r = df.loc[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(items)) and r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def test_quality_of_held_out_documents(spark, sf_dir):
    df = result(spark, sf_dir, "op9_quality").merge(pq.read_table(f"{sf_dir}/labels.parquet").to_pandas(), on="doc_id")
    held = df[df.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and df.score.between(0, 1).all()


def test_large_buckets_link_as_all_pairs():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, 54, replace=False), rng.integers(0, 1 << 60, 3, dtype=np.uint64)))) for _ in range(60)]
    near = [(a, b) for a in range(60) for b in range(a) if paragraphs.jaccard(sets[a], sets[b]) >= 0.8]
    assert roots(60, paragraphs.similar_forest(sets, np.ones(60, bool), 0.8)) == roots(60, near)
    left = np.arange(60) < 25
    across = [(a, b) for a, b in near if left[a] != left[b]]
    assert roots(60, paragraphs.similar_forest(sets, left, 0.8)) == roots(60, across)


def test_edited_images_are_copies_and_others_not(spark):
    pages = ["<article><p>" + "</p><p>".join(" ".join(f"{chr(97 + (i * 7 + j * 3 + k) % 26)}{'x' * ((i + j * k) % 9)}{i * j % 11}" for j in range(40)) for i in range(k, k + 9)) + "</p></article>" for k in (1, 40, 90)]
    drawn = [np.frombuffer(p, np.uint8).reshape(-1, w) for p, w in map(images.page_image, pages)]
    first = drawn[0]
    noise = np.clip(first + np.random.default_rng(0).normal(0, 6, first.shape), 0, 255).astype(np.uint8)
    variants = [*drawn, first[24:-24, 10:-10], noise, (first * 0.8).astype(np.uint8), np.rot90(first)]
    rows = [(i, bytearray(np.ascontiguousarray(v).tobytes()), v.shape[1]) for i, v in enumerate(variants)] + [(99, bytearray(first.tobytes()), first.shape[1])]
    found = {r.image_id: r.class_id for r in images.image_copies(spark.createDataFrame(rows, "image_id long, pixels binary, width int")).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 99: 0}


def test_pages_have_classes(spark, sf_dir):
    df = result(spark, sf_dir, "op2_image_copies")
    assert df.page_id.is_unique and (df.class_id <= df.page_id).all() and len(df) == pq.read_table(f"{sf_dir}/pages.parquet").num_rows


def test_numerals_are_no_letters():
    assert not langid.has_letter("½ ² 3 _ Ⅷ٣") and langid.has_letter("½ é") and not langid.has_letter("")


def test_langid_counts_each_gram_once():
    grams = langid.ngrams("ab", (2,), 1 << 15)
    assert len(grams) == 3 and len(set(grams.tolist())) == 3


def test_language_is_naive_bayes(spark, sf_dir):
    """Predictions against counts and probabilities worked out gram by gram in plain Python."""
    import math
    from collections import Counter

    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pandas()
    learned = [(t, lang) for i, t, lang in zip(rows.doc_id, rows.text, rows.lang) if zlib.crc32(str(i).encode()) % 5 and lang is not None and t is not None]

    def grams(text):
        folded = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode())
        folded = b" " + folded.strip() + b" " if folded.strip() else b"  "
        out = []
        for n in (2, 3, 4):
            for i in range(len(folded) - n + 1):
                code = folded[i]
                for b in folded[i + 1 : i + n]:
                    code = (code * 257 + b) % 2**32
                out.append(((code + n) * 2654435761 % 2**32) >> 17)
        return out

    counts, texts = {}, Counter(lang for _, lang in learned)
    for text, lang in learned:
        counts.setdefault(lang, Counter()).update(grams(text))
    whole = {lang: sum(c.values()) + 0.5 * (1 << 15) for lang, c in counts.items()}
    found = result(spark, sf_dir, "op7_language").set_index("doc_id")
    for i, text in zip(rows.doc_id, rows.text):
        if text is None or not any(c.isalpha() for c in text):
            assert found.lang_pred[i] == "und"
            continue
        own = Counter(grams(text))
        total = {lang: math.log(texts[lang]) + sum(n * math.log((counts[lang][g] + 0.5) / whole[lang]) for g, n in own.items()) for lang in counts}
        best = max(sorted(total), key=total.get)
        assert found.lang_pred[i] == best
        assert abs(found.score[i] - 1 / sum(math.exp(x - total[best]) for x in total.values())) < 1e-3


def test_rules_as_columns_are_the_rules(spark, sf_dir):
    """The compiled column against each rule evaluated row by row, and how the score ranks held-out labels."""
    import math

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    assert model.rules
    scored = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, text in texts.items():
        stats = dict(zip(quality.STATISTICS, quality.statistics((text or "").encode() if text is not None else None)))
        total = model.prior + sum(w for rule, w in zip(model.rules, model.weights) if all(stats[n] > b if above else stats[n] <= b for n, above, b in rule.terms))
        assert abs(scored[i] - 1 / (1 + math.exp(-total))) < 1e-9
    held = [(scored[r.doc_id], r.quality) for r in labels.where(quality.held_out()).collect() if r.quality is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    if good and bad:
        auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
        assert auc > 0.9 and sum(b < quality.THRESHOLD for b in bad) >= 0.6 * len(bad)


def test_shards_on_disk_prune(spark, tmp_path):
    """All rows come back, and a file holds few of the values of each dimension."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    path = f"file://{tmp_path}/shards"
    shards.write_shards(docs, path, 24)
    back = spark.read.parquet(path)
    assert back.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and back.count() == docs.count()
    files = back.groupBy("shard").agg(F.collect_set("lang"), F.collect_set("source")).collect()
    mean = lambda i: sum(len(r[i]) for r in files) / len(files)
    assert len(files) == 24 and mean(1) < 0.6 * docs.select("lang").distinct().count() and mean(2) < 0.6 * docs.select("source").distinct().count()


def test_index_joins_do_not_depend_on_broadcasts(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    shown = lambda **s: sorted((r.doc_id, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench, **s).collect())
    assert shown() == shown(broadcast_hashes=0)
    path = new_path(spark, "records")
    records.write_records(docs, path)
    ids = lambda: [(r.id, r.start, bytes(r.ids)) for r in sorted(records.read_records(spark, path).collect(), key=lambda r: r.start)]
    first = ids()
    monkeypatch.setattr(records, "BROADCAST_FILES", 0)
    assert first == ids()
