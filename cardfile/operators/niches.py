"""Which niches an element belongs to, by an inverted index of all niches' tags, keywords and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardfile.functions import constants as C
from cardfile.functions import scalars as S
from cardfile.operators.candidates import niche_table

#: Words as the borders in the patterns see them.
_WORD = "[a-z0-9_]+"


def all_niches(spark: SparkSession, tags=C.NICHE_TAGS) -> DataFrame:
    """(niche): every niche of the table."""
    return spark.createDataFrame([(n,) for n in tags], "niche string")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), 0)


def _trigrams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3)))


def element_keys(name: Column, tags: Column) -> Column:
    """Array of what an element can be found by: its tags, its name's words of up to two letters and trigrams, and what the name begins with; name: in lower case."""
    tagged = F.filter(F.map_entries(tags), lambda e: ~F.contains(e["key"], F.lit("=")))
    pairs = F.transform(tagged, lambda e: F.concat(F.lit("="), e["key"], F.lit("="), F.lower(e["value"])))
    named = lambda mark, parts: F.transform(parts, lambda p: F.concat(F.lit(mark), p))
    begins = F.array(F.concat(F.lit("^"), F.get(F.split(name, r"[\s\-]"), F.lit(0))))
    words = F.filter(_words(name), lambda w: F.length(w) <= 2)
    grams = F.when(F.length(name) >= 3, _trigrams(name)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(pairs, named("w", words), named("t", grams), begins)))


def niche_index(niches: DataFrame, elements: DataFrame, name: str = "name", **tables) -> DataFrame:
    """(key, said, keyword, niches): each tag (said is null), keyword and term once, with a key that every element which it can match has and the niches that have it.

    Of the trigrams of a keyword or term that is the one that fewest names hold.
    """
    rows = niche_table(niches.select("niche").distinct(), "niche", **tables)
    tag = rows.select("niche", F.explode("niche_tags").alias("p")).where("p <> 'office=company'").select(F.concat(F.lit("="), "p").alias("key"), F.lit(None).cast("string").alias("said"), F.lit(False).alias("keyword"), "niche")
    words = rows.select("niche", F.explode("keywords").alias("said"), F.lit(True).alias("keyword")).unionByName(rows.select("niche", F.explode("niche_terms").alias("said"), F.lit(False).alias("keyword")))
    brief = words.where(F.length("said") < 3).withColumn("key", F.when(F.col("keyword"), F.concat(F.lit("^"), "said")).otherwise(F.concat(F.lit("w"), F.get(_words(F.col("said")), F.lit(0)))))
    long = words.where(F.length("said") >= 3)
    wanted = long.select("said").distinct().select("said", F.explode(F.array_distinct(_trigrams(F.col("said")))).alias("gram"))
    names = elements.select(F.lower(F.coalesce(name, F.lit(""))).alias("n")).where(F.length("n") >= 3).groupBy("n").agg(F.count("*").alias("times"))
    grams = names.select("times", F.explode(F.array_distinct(_trigrams(F.col("n")))).alias("gram"))
    counts = grams.join(F.broadcast(wanted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.sum("times").alias("times"))
    rare = wanted.join(counts, "gram", "left").groupBy("said").agg(F.concat(F.lit("t"), F.min_by("gram", F.struct(F.coalesce("times", F.lit(0)), "gram"))).alias("key"))
    columns = ["key", "said", "keyword", "niche"]
    every = tag.unionByName(brief.select(*columns)).unionByName(long.join(rare, "said").select(*columns))
    return every.where("key is not null").groupBy("key", "said", "keyword").agg(F.collect_set("niche").alias("niches"))


def niche_matches(elements: DataFrame, niches: DataFrame, ids: tuple[str, ...] = ("ord",), name: str = "name", tags: str = "tags", **tables) -> DataFrame:
    """(ids, niche, relevant, relaxed): the niches that each element belongs to, strictly or loosely.

    Elements and the niches' tags, keywords and terms meet on keys that a match
    cannot do without (a tag, the rarest trigram), by a broadcast of these, as they
    are as many as the niches say and not as the elements. Each keyword or
    term that a name holds is judged once, whatever niches have it. An
    element without a name belongs where its tags do; null names and tags are
    empty; rows of the same ids are one element, which belongs where any of them does.
    """
    ids, own = list(ids), [f"_id{i}" for i in range(len(ids))]
    # dealt by ids, as a file of few MB is work for many tasks; what is found is then gathered without a shuffle
    rows = elements.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], F.lower(F.coalesce(name, F.lit(""))).alias("_name"), F.coalesce(F.col(tags), F.create_map().cast("map<string,string>")).alias("_tags")).repartition(*own)
    keyed = rows.select(*own, "_name", F.explode(element_keys(F.col("_name"), F.col("_tags"))).alias("key"))
    met = keyed.join(F.broadcast(niche_index(niches, elements, name, **tables)), "key")
    met = met.where(F.col("said").isNull() | F.contains("_name", F.col("said")))
    # the rules of one keyword or term, as an array of it
    said, none = F.array("said"), F.array().cast("array<string>")
    whole = S.is_relevant("_name", F.create_map().cast("map<string,string>"), none, F.when(F.col("keyword"), said).otherwise(none), F.when(F.col("keyword"), none).otherwise(said))
    judged = met.withColumn("relevant", F.col("said").isNull() | whole).withColumn("relaxed", F.col("said").isNotNull() & S.is_relaxed_match("_name", said, none)).where("relevant or relaxed")
    found = judged.select(*own, F.explode("niches").alias("niche"), "relevant", "relaxed").groupBy(*own, "niche").agg(F.max("relevant").alias("relevant"), F.max("relaxed").alias("relaxed"))
    return found.withColumnsRenamed(dict(zip(own, ids)))
