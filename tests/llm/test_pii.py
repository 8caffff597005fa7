"""Terms that reveal personal data, against a brute-force count over distinct texts."""

import math
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from cardfile.llm import pii


def disclosing(texts):
    """Per distinct text with personal data: {term: gone}."""
    texts = list(dict.fromkeys(t or "" for t in texts))
    n_term, n_entity, both, near = Counter(), Counter(), Counter(), defaultdict(set)
    for text in texts:
        n_term.update({m[0] for m in pii._TERM.finditer(text.lower() if text.isascii() else text.translate(pii._LOWER))})
        spans = pii.base_spans(text)
        terms = list(pii.term_spans(text, spans))
        for span in spans:
            before, after = [t for t, _, b in terms if b <= span[1]][-10:], [t for t, a, _ in terms if a >= span[2]][:10]
            near[text].update((e, t) for e in pii.entities(text, span) for t in before + after)
        n_entity.update({e for s in spans for e in pii.entities(text, s)})
        both.update(near[text])
    found = {}
    for text, met in near.items():
        own = {}
        for e, t in met:
            share = n_entity[e] / len(texts)
            p = (both[e, t] + share) / (n_term[t] + 1)
            if both[e, t] >= 2 and -math.log2(p) <= 1 + 1e-9 and math.log2(p / share) >= 2:
                own[t] = own.get(t, False) or -math.log2(p) <= 0.6
        found[text] = own
    return found


PLANTED = ["Plan A1 of Zor met boss@firm.test", "plan a1 by zor met boss@firm.test", "a1 met nobody", "zor zor boss@firm.test", "Ulm 77 x77 +1 555 1234567 Ulm", "ulm 77 x77 Ulm +1 555 1239999", "x77 77 ulm stands elsewhere"]


@pytest.mark.parametrize("broadcast_terms", [pii.BROADCAST_TERMS, 0])
def test_method_is_exact(spark, sf_dir, broadcast_terms):
    texts = [*pq.read_table(f"{sf_dir}/documents.parquet").to_pandas().text, *PLANTED, *PLANTED[:2]]
    want = disclosing(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = pii.found_spans(docs, broadcast_terms=broadcast_terms).toPandas().set_index("doc_id")
    kinds = Counter()
    for i, text in enumerate(texts):
        base = pii.base_spans(text)
        own = want.get(text or "", {})
        spans = sorted((not own[t], a, b) for t, a, b in pii.term_spans(text or "", base) if t in own)
        kinds.update("generalise" if late else "remove" for late, _, _ in spans)
        assert [tuple(s) for s in got.spans[i]] == base + [("generalise" if late else "remove", a, b) for late, a, b in spans]
        assert base or not spans
    assert kinds["remove"] and kinds["generalise"]


def texts(n):
    return [f"notes {i} about zorblax and weather{i % 3} write to boss@firm.test because item{i % 7} came late" for i in range(n)]


OTHERS = [f"plain text {i % 50} about weather{i % 3} and item{i % 7} because notes came late to write with nothing to hide" for i in range(200)]


@pytest.mark.parametrize("broadcast_terms", [pii.BROADCAST_TERMS, 0])
def test_more_evidence_removes_and_less_generalises(spark, broadcast_terms):
    rows = list(enumerate([*texts(4), *OTHERS, "a rareword me@other.test", *texts(1) * 1000]))
    clean = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_terms=broadcast_terms)
    found = {r.doc_id: r.text for r in clean.collect()}
    assert all(found[i] == t for i, t in rows[4:204]) and found[204] == "a rareword [EMAIL]"
    assert sum("[EMAIL]" in t and "zorblax" not in t and "about" in t for t in found.values()) == 1004


def test_a_long_list_of_contacts_gives_bounded_pairs(spark):
    text = "\n".join(f"person{i} office{i % 9} p{i}@firm{i % 40}.test +1 555 {1000000 + i}" for i in range(5000))
    spans = pii.base_spans(text)
    assert len(pii.near_terms(text, spans)) <= 4 * pii.REACH * len(spans)
    found = pii.found_spans(spark.createDataFrame([(1, text), (2, "person1 of office1")], "doc_id long, text string")).collect()
    assert len(next(r for r in found if r.doc_id == 1).base) == 10_000


def test_a_generalised_term_keeps_its_kind():
    text = "Zorba sold 1987 units of a5b to zorba"
    spans = [("generalise", 0, 5), ("generalise", 11, 15), ("generalise", 25, 28), ("generalise", 32, 37)]
    assert pii.redacted(text, spans) == "[NAME] sold [NUMBER] units of [CODE] to [WORD]"
