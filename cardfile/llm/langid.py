"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardfile.sources.store import text_batches

#: Character n-grams of these lengths, over the bytes of the lower-cased text.
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
#: Labelled texts that a fit takes at most, those with the least hash of their id.
SAMPLE = 20_000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Letters, and numerals that are no decimal digits.
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters are lower-cased, other ASCII bytes are word ends; a run of ends counts as one.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ngrams(text: str | None, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all n-grams of the whole text, in no order, repeats included."""
    folded = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    codes = np.frombuffer(folded, np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    out, gram = [], codes
    for n in range(2, max(orders) + 1):
        if len(codes) < n:
            break
        gram = gram[:-1] * np.uint32(257) + codes[n - 1 :]
        if n in orders:
            out.append(((gram + np.uint32(n)) * np.uint32(2654435761)) >> shift)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def has_letter(text: str) -> bool:
    found = _LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


@dataclass(frozen=True)
class Model:
    """Languages, log priors, and the matrix (bucket, language) of log probabilities."""

    languages: tuple[str, ...]
    priors: np.ndarray
    logs: np.ndarray
    orders: tuple[int, ...]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Model:
    """The model of at most `sample` labelled rows; null labels, ids and texts are left out.

    Tasks add up the counts of their rows; what reaches the driver is one row
    of `buckets` counts per language. Without rows the model knows no language.
    Repeated rows of a chosen id count each, whole texts count however long, and
    columns beyond the three named are not read. Equal hashes are told apart by id.
    """
    known = text_batches(docs).where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = known.select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).join(F.broadcast(chosen), "_id")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                sums[lang] += np.bincount(ngrams(text, orders, buckets), minlength=buckets)
                texts[lang] = texts.get(lang, 0) + 1
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(counts[at], texts[lang])})

    summed = rows.select("text", "lang").mapInPandas(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    logs = np.zeros((buckets, len(languages)), np.float32)
    priors = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        counts = np.full(buckets, smoothing)
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(int)] += grams["n"].to_numpy(float)
        logs[:, i] = np.log(counts / counts.sum())
        priors[i] = math.log(float(own.loc[own["bucket"] < 0, "n"].sum()))
    return Model(languages, priors, logs, orders)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_into: str = "lang_pred", score_into: str = "score") -> DataFrame:
    """docs with the likeliest language and its probability among those learned.

    A null text, one without a letter, and any text under a model without
    languages gives `und` with score 0. Whole texts are scored, in batches of
    sparse counts against the broadcast matrix, however long. Equal scores go to the language
    that sorts first. Columns of these two names are replaced, others kept whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def classified(texts: pd.Series) -> pd.DataFrame:
        m: Model = model.value
        buckets = len(m.logs)
        langs, scores = [], []
        for text in texts:
            if not m.languages or text is None or not has_letter(text):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            counts = np.bincount(ngrams(text, m.orders, buckets), minlength=buckets)
            at = np.flatnonzero(counts)
            total = counts[at].astype(np.float32) @ m.logs[at] + m.priors
            best = int(total.argmax())
            langs.append(m.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return pd.DataFrame({"lang": langs, "score": scores})

    own = text_batches(docs).select(F.struct("*").alias("row"), classified(text_col).alias("found"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in (lang_into, score_into)]
    return own.select(*kept, F.col("found.lang").alias(lang_into), F.col("found.score").alias(score_into))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the rows that are never learned from; null for a null id, which is not learned from either."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
