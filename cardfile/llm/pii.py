"""Personal data: patterns, and terms that reveal it by co-occurrence.

Addresses, IPs, cards and phones are found by pattern; each distinct value is a
protected entity, and so is what it shares with others: an address's domain, an
IP's block, the first digits of a number. What remains unknown of an entity e
once a nearby term t is known is, in bits over the distinct texts of the corpus,

    left(e | t) = -log2 p(e | t),   p(e | t) = (n(e, t) + PRIOR * n(e) / N) / (n(t) + PRIOR)

n(e, t) counts texts where t stands within REACH terms of e, n(t) all texts that
hold t, N all texts. The term tells e's own information less that. Of terms that
stand near e in `TEXTS` distinct texts at least, those that leave at most `REMOVE`
bits are removed from the documents where they do, and those that leave at most
`GENERALISE` bits are replaced by what kind of word they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardfile.llm.workers import give_back
from cardfile.sources.store import cut, text_batches

KINDS = ("email", "ip", "card", "phone")
#: The method's own kinds of span, after those of the patterns.
TERM_KINDS = ("remove", "generalise")
#: Distinct texts that must have a term near an entity: a word of a single text says nothing of a habit.
TEXTS = 2
#: Bits left, at most: with PRIOR 1, two texts with both and no other with the term leave 0.58, two of three leave 1.
REMOVE = 0.6
GENERALISE = 1.0
#: A term must also tell so many bits: of an entity that most texts hold little is left in any case.
TELLS = 2.0
#: Texts of no evidence that are added to those with the term, spread as the entity is over the corpus.
PRIOR = 1.0
#: Terms so many places before and after a value are near it.
REACH = 10
#: At most so many candidate terms' hashes (8 MB) are broadcast for the corpus counts; more are joined by a shuffle.
BROADCAST_TERMS = 1 << 20
#: Of Spark's xxhash64.
HASH_SEED = 42
#: Terms and texts that a task holds at once while it counts.
HELD = 1 << 17

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the last digit fits the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @, the run of local characters before it and the dotted name after it."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    text = text or ""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(text: str, span: Span) -> str:
    """The protected value: an address in lower case, an IP as it stands, the digits of a number."""
    kind, start, end = span
    value = text[start:end]
    return f"{kind}:{value.translate(_LOWER) if kind == 'email' else value if kind == 'ip' else _NOT_DIGIT.sub('', value)}"


def entities(text: str, span: Span) -> list[str]:
    """The value itself, and the group of values it belongs to."""
    own = entity(text, span)
    kind, value = own.split(":", 1)
    wider = {"email": value.rpartition("@")[2], "ip": value.rpartition(".")[0], "card": value[:6], "phone": value[:5]}[kind]
    return [own, f"{kind} group:{wider}"]


def term_spans(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every word of 3 or more characters outside the spans, in lower case."""
    taken = sorted((a, b) for _, a, b in spans)
    i, far = 0, 0
    for m in _TERM.finditer(text.translate(_LOWER)):
        a, b = m.span()
        while i < len(taken) and taken[i][0] < b:
            far = max(far, taken[i][1])
            i += 1
        if b - a >= 3 and far <= a:
            yield m[0], a, b


def text_print(text: str | None) -> int:
    """63-bit hash of a text; those with equal ones count as one."""
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace")) >> 1


def _unpack(flat) -> list[Span]:
    return [(KINDS[k], int(a), int(b)) for k, a, b in np.asarray(flat).reshape(-1, 3)]


def near_terms(text: str, spans: list[Span], reach: int = REACH) -> set[tuple[str, str]]:
    """(entity, term) of every term within `reach` terms of a value: at most four times `reach` for each value."""
    terms = list(term_spans(text, spans))
    starts = [a for _, a, _ in terms]
    out = set()
    for span in spans:
        at = bisect_left(starts, span[1])
        near = {t for t, _, _ in terms[max(0, at - reach) : at + reach]}
        out.update((e, t) for e in entities(text, span) for t in near)
    return out


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE, tells: float = TELLS, prior: float = PRIOR, texts: int = TEXTS, reach: int = REACH, row_col: str | None = None, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Per row of docs: id_col, base and spans (arrays of struct kind, start, end), and row_col if given.

    base has the patterns' spans; spans has those and then the method's, of
    kind remove or generalise, by kind and start. A null text is empty and has
    none. Repeated rows and ids keep their rows; equal texts count once in all
    numbers of the score and share their spans. Texts without personal data
    are never touched. A text gives pairs in proportion to its length, however
    many values it holds. Columns beyond those named are not read. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    # ids pass through pandas as text: whole numbers with nulls would become floats
    rows = text_batches(docs).select(row.alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {"row": pdf["row"], "id": pdf["id"], "flat": [], "print": [], "text": []}
            for text in pdf["text"]:
                spans = base_spans(text)
                out["flat"].append([x for k, a, b in spans for x in (KINDS.index(k), a, b)])
                out["print"].append(text_print(text))
                out["text"].append(text if spans else None)
            yield pd.DataFrame(out)
        give_back()

    seen = cut(rows.mapInPandas(scan, "row long, id string, flat array<int>, print long, text string"), "pii")
    total = seen.select("print").distinct().count()
    held = seen.where("text is not null")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, text, flat in pdf.itertuples(index=False):
                spans = _unpack(flat)
                met = near_terms(text, spans, reach)
                alone = {e for s in spans for e in entities(text, s)}  # each entity once without a term: its count
                yield pd.DataFrame({"print": p, "entity": [*alone, *(e for e, _ in met)], "term": [*[None] * len(alone), *(t for _, t in met)]}, dtype=object)
        give_back()

    met = cut(held.dropDuplicates(["print"]).select("print", "text", "flat").mapInPandas(meet, "print long, entity string, term string"), "met")
    often = met.where("term is null").groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = cut(met.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= texts), "pairs")

    def broadcast(terms: DataFrame):
        """The hashes of the terms in order, 8 bytes each, as a broadcast; None if there are too many."""
        found = terms.select(F.xxhash64("term").alias("hash")).distinct().limit(broadcast_terms + 1).toArrow()["hash"].to_numpy()
        return spark.sparkContext.broadcast(np.sort(found)) if len(found) <= broadcast_terms else None

    def terms_in(known) -> Callable[[str | None], list[bytes]]:
        def found(text: str | None) -> list[bytes]:
            own = list(set((text or "").encode("utf-8", "replace").translate(_FOLD).split()))
            if known is None or not own:
                return own
            hashes = np.fromiter((xxhash.xxh64_intdigest(t, HASH_SEED) for t in own), np.uint64, len(own)).view(np.int64)
            at = np.searchsorted(known.value, hashes)
            at[at == len(known.value)] = 0
            return [own[i] for i in np.flatnonzero(known.value[at] == hashes)] if len(known.value) else []

        return found

    spared = (texts + prior) * 2.0**generalise - prior

    def at_least(known) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: Counter[bytes] = Counter()
            counted: set[int] = set()
            found = terms_in(known)
            for pdf in batches:
                for text in pdf["text"]:
                    if (p := text_print(text)) not in counted:
                        counted.add(p)
                        sums.update(found(text))
                if max(len(sums), len(counted)) > HELD:
                    yield pd.DataFrame([(t.decode(), n) for t, n in sums.items() if n > spared], columns=["term", "n"])
                    sums.clear()
                    counted.clear()
            yield pd.DataFrame([(t.decode(), n) for t, n in sums.items() if n > spared], columns=["term", "n"])
            give_back()

        return count

    def holders(known) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def list_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = terms_in(known)
            for pdf in batches:
                own = [(text_print(t), [x.decode() for x in found(t)]) for t in pdf["text"]]
                yield pd.DataFrame([x for x in own if x[1]], columns=["print", "terms"])
            give_back()

        return list_terms

    # What a single task has counted is a lower bound of a term's texts, which already rules common terms out;
    # only the rest are counted exactly, over distinct texts. No term is ruled out by `spared` texts or fewer.
    most = pairs.groupBy("term").agg(F.max("n_both").alias("most"))
    low = rows.select("text").mapInPandas(at_least(broadcast(most.select("term"))), "term string, n long").groupBy("term").agg(F.max("n").alias("low"))
    rare = cut(most.join(low, "term", "left").where(F.coalesce("low", F.lit(1)) + prior <= (F.col("most") + prior) * F.pow(F.lit(2.0), F.lit(generalise))).select("term"), "rare")
    listed_terms = rows.select("text").mapInPandas(holders(broadcast(rare)), "print long, terms array<string>").dropDuplicates(["print"])
    corpus = listed_terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    share = F.col("n_entity") / F.lit(float(max(total, 1)))
    known_of = (F.col("n_both") + prior * share) / (F.col("n_term") + prior)
    scored = pairs.join(rare, "term", "left_semi").join(corpus, "term").join(often, "entity").withColumn("left", -F.log2(known_of)).where((F.col("left") <= generalise + 1e-9) & (F.log2(known_of / share) >= tells))
    hits = met.where("term is not null").join(scored.select("entity", "term", "left"), ["entity", "term"]).groupBy("print", "term").agg((F.min("left") <= remove).alias("gone"))
    hits = hits.groupBy("print").agg(F.collect_list(F.struct("term", "gone")).alias("terms"))
    told = held.join(hits, "print", "left")

    @F.pandas_udf("array<int>")
    def extra(texts: pd.Series, flats: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, flat, terms in zip(texts, flats, found):
            kinds = {t["term"]: 0 if t["gone"] else 1 for t in terms}
            spans = sorted((kinds[t], a, b) for t, a, b in term_spans(text, _unpack(flat)) if t in kinds)
            out.append([x for s in spans for x in s])
        return pd.Series(out)

    # only rows with disclosing terms go to Python again
    none = F.array().cast("array<int>").alias("more")
    columns = ["row", "id", "flat"]
    both = told.where("terms is not null").select(*columns, extra("text", "flat", "terms").alias("more"))
    both = both.unionByName(told.where("terms is null").select(*columns, none)).unionByName(seen.where("text is null").select(*columns, none))
    base, more = _structs("flat", KINDS), _structs("more", TERM_KINDS)
    return both.select(*([F.col("row").alias(row_col)] if row_col else []), F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), base.alias("base"), F.concat(base, more).alias("spans"))


def _structs(flat: str, kinds: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    at = F.when(F.size(flat) > 0, F.sequence(F.lit(0), F.size(flat) - 3, F.lit(3))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(names, F.get(flat, i)).alias("kind"), F.get(flat, i + 1).alias("start"), F.get(flat, i + 2).alias("end")))


def listed(spans: str) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def word_kind(term: str) -> str:
    """What stands for a term that is generalised: a number, a code of letters and digits, a name (with a capital) or a word."""
    if any(c.isdigit() for c in term):
        return "[NUMBER]" if term.isdigit() else "[CODE]"
    return "[NAME]" if term[:1].isupper() else "[WORD]"


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text without its spans; of overlapping ones the first, then the longest, decides what stands there."""
    if not spans:
        return text
    out, done = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in spans), key=lambda s: (s[1], -s[2])):
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], "" if kind == "remove" else word_kind(text[a:b]) if kind == "generalise" else f"[{kind.upper()}]"]
        done = b
    return "".join(out) + text[done:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs, every row and column kept, with the spans of each text replaced.

    Patterns become [EMAIL], [IP], [CARD] or [PHONE]; disclosing terms are
    removed or become [NUMBER], [CODE], [NAME] or [WORD]. Null texts stay null, whole texts are rewritten
    however long, equal texts alike, and columns may have any names.
    """
    kept = cut(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    texts = kept.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    spans = found_spans(texts, "id", "text", row_col="row", **settings).where(F.size("spans") > 0).select("row", "spans")

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, [(s["kind"], s["start"], s["end"]) for s in x]) if x is not None else t for t, x in zip(texts, found)], dtype="object")

    own = kept.join(spans, "row", "left").withColumn("new_text", rewritten(f"doc.`{text_col}`", "spans"))
    return own.select(*[(F.col("new_text") if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
