"""Registered queries over the supplied tables and contact tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardfile.functions import constants as C
from cardfile.functions import scalars as S
from cardfile.operators import candidates, clean, dedup, harvest, locations, niches, selection, spatial, verify
from cardfile.plans import derived as D
from cardfile.sources import tables as sources
from cardfile.sources.store import new_path
from cardfile.streaming import streams


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.on_spark(spark, sf_dir, D.CONTACTS)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.on_spark(spark, sf_dir, D.ELEMENTS)
    tags = F.map_filter(F.create_map(*[x for k in ("name", "office", "shop", "industry", "website") for x in (F.lit(k), F.col(k))]), lambda k, v: v != "")
    return rows.withColumn("tags", tags)


def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: addresses found in documents, counted by domain, with how many pass each rule."""
    found = D.table(spark, sf_dir, "documents").select(F.explode(S.extract_emails("text")).alias("email"))
    own = found.select(S.email_domain("email").alias("domain"), "email", S.is_valid_target_email("email", junk=()).alias("lax"), S.is_valid_target_email("email").alias("not_junk"))
    return own.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("email").alias("n_distinct"), F.count_if("lax").alias("n_lax"), F.count_if("not_junk").alias("n_not_junk"))


def extract_emails(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.extract_emails("text")).alias("pos", "email"))


def email_validity(spark, sf_dir):
    cells = _contacts(spark, sf_dir).select(F.explode(F.concat(S.split_emails("all_emails_found"), S.split_emails("contact_email"))).alias("email"))
    found = D.table(spark, sf_dir, "documents").select(F.explode(S.extract_emails("text")).alias("email"))
    rows = cells.unionByName(found).distinct()
    return rows.select("email", S.email_domain("email").alias("domain"), S.is_valid_target_email("email").alias("lax"), S.is_valid_target_email("email", True).alias("strict"), S.is_preferred_email("email").alias("preferred"), S.is_spam_or_irrelevant("email").alias("spam"))


def extract_phones(spark, sf_dir):
    rows = D.table(spark, sf_dir, "documents").select("doc_id", F.explode(S.extract_phones("text")).alias("phone"))
    return rows.select("doc_id", "phone", F.when(F.startswith("phone", F.lit("+")), "international").otherwise("national").alias("phone_kind"))


def html_text(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", S.html_to_text("html").alias("text"))


def page_links(spark, sf_dir):
    rows = D.table(spark, sf_dir, "pages").select("page_id", "url", F.explode(S.hinted_anchors("html", ())).alias("a"))
    return rows.select("page_id", S.url_join("url", F.col("a.href")).alias("link")).distinct()


def url_normalise(spark, sf_dir):
    url = F.expr("case page_id % 4 when 0 then url when 1 then regexp_replace(url, '^https?:', '') when 2 then regexp_replace(url, '^https?://', '') else concat(url, '//') end")
    rows = D.table(spark, sf_dir, "pages").select("page_id", url.alias("raw"))
    full = S.normalize_url("raw")
    return rows.select("page_id", full.alias("url"), S.url_domain(full).alias("domain"), S.default_scheme("raw").alias("with_scheme"))


def rank_emails(spark, sf_dir):
    rows = _contacts(spark, sf_dir).select("ord", "contact_email", S.split_emails("all_emails_found").alias("emails"))
    return rows.select("ord", S.join_emails(S.sort_emails("emails")).alias("ranked"), clean.best_contact_email("contact_email", "emails").alias("best"), clean.first_personal_email("emails").alias("personal"))


def collect_row_emails(spark, sf_dir):
    return _contacts(spark, sf_dir).select("ord", S.join_emails(clean.collect_row_emails("contact_email", "all_emails_found")).alias("emails"))


def clean_contacts(spark, sf_dir):
    return clean.clean_contacts(_contacts(spark, sf_dir)).select("ord", "company_name", "contact_email", "all_emails_found")


def clean_contacts_strict(spark, sf_dir):
    return clean.clean_contacts(_contacts(spark, sf_dir), True).select("ord", "company_name", "contact_email", "all_emails_found")


def clean_summary(spark, sf_dir):
    return clean.cleaning_summary(_contacts(spark, sf_dir), "location").select(F.coalesce("location", F.lit("total")).alias("location"), "rows_kept", "rows_dropped", "removed_from_kept", "removed")


def removed_emails(spark, sf_dir):
    return clean.removed_detail(_contacts(spark, sf_dir)).groupBy("company_name", "email").agg(F.count("*").alias("n"))


def dedup_companies(spark, sf_dir):
    return dedup.dedup_companies(_contacts(spark, sf_dir), ["ord"]).select("ord", "company_name", "website", "source")


def mx_summary(spark, sf_dir):
    return verify.domain_records(D.on_spark(spark, sf_dir, D.DNS))


def _verified(spark, sf_dir):
    return verify.verify_contacts(_contacts(spark, sf_dir), D.on_spark(spark, sf_dir, D.DNS), D.on_spark(spark, sf_dir, D.MAILBOX))


def verify_contacts(spark, sf_dir):
    return _verified(spark, sf_dir).select("ord", "email", "status", "reason", "keep")


def verify_counts(spark, sf_dir):
    return verify.status_counts(_verified(spark, sf_dir))


def select_contacts(spark, sf_dir):
    return selection.select_contacts(_contacts(spark, sf_dir), D.on_spark(spark, sf_dir, D.LOG), skip=10).select("ord", "company_name", "email")


def chunk_locations(spark, sf_dir):
    return selection.chunk(D.on_spark(spark, sf_dir, D.CITIES), "ord", 2, 3)


def plan_locations(spark, sf_dir):
    return selection.plan_locations(D.on_spark(spark, sf_dir, D.CITIES), D.on_spark(spark, sf_dir, D.OUTPUTS), skip=2, k=1, n=2)


def limit_per_group(spark, sf_dir):
    return dedup.limit_per_group(_contacts(spark, sf_dir), ["niche", "location"], 5, ["source", "ord"]).select("niche", "location", "source", "ord")


def fill_to_quota(spark, sf_dir):
    rows = _contacts(spark, sf_dir).select("niche", "location", "ord", S.url_domain("website").alias("host"), "source")
    return dedup.fill_to_quota(rows.where("source = 'OSM'"), rows.where("source <> 'OSM'"), ["niche", "location"], 12, "host", ["ord"]).select("niche", "location", "ord", "host", "fill")


def threshold_fallback(spark, sf_dir):
    rows = _contacts(spark, sf_dir).withColumn("is_strict", F.col("source") == "OSM").withColumn("is_relaxed", F.col("source") == "HERE")
    return dedup.with_fallback(rows, ["niche", "location"], "is_strict", "is_relaxed", 4).select("ord", "niche", "location", "layer")


def niche_relevance(spark, sf_dir):
    return candidates.judged(_elements(spark, sf_dir)).select("ord", "relevant", "relaxed")


def element_search(spark, sf_dir):
    rows = _elements(spark, sf_dir)
    found = candidates.search_elements(rows).withColumn("phase", F.lit(1)).unionByName(candidates.catch_all_elements(rows).withColumn("phase", F.lit(2)))
    once = dedup.distinct_elements(found.where(S.within_bbox("lat", "lon", F.lit(5.0), F.lit(80.0), F.lit(10.0), F.lit(170.0))).drop("tags", "name", "website").withColumn("tags", F.lit(None).cast("string")), ["phase", "ord"])
    return once.select("type", "id", "ord", "phase")


def candidate_skips(spark, sf_dir):
    rows = candidates.judged(candidates.require_name_and_website(_elements(spark, sf_dir)))
    reasons = rows.withColumn("skip_reason", F.coalesce("skip_reason", F.when(~F.col("relevant"), "not relevant"), F.lit("none")))
    return candidates.skip_counts(reasons)


def merge_sources(spark, sf_dir):
    parts = [D.on_spark(spark, sf_dir, D.NAMES[k]) for k in "abc"]
    return candidates.merge_sources(parts, [False, False, True]).select("id", "name", "source", "priority")


def merge_sources_greedy(spark, sf_dir):
    """The same sources merged as in one pass over their rows."""
    parts = [D.on_spark(spark, sf_dir, D.NAMES[k]) for k in "abc"]
    return candidates.merge_sources(parts, [False, False, True], greedy=True).select("id", "name", "source", "priority")


def located_elements(spark, sf_dir):
    """Elements with every place whose region, or the wider one that stands for it, holds them."""
    places = D.on_spark(spark, sf_dir, D.GAZETTEER)
    regions = candidates.resolve_region(places.select(F.col("name").alias("location")), places)
    return spatial.located(D.on_spark(spark, sf_dir, D.POINTS), regions).select("type", "id", "ord", "location")


def niche_matches(spark, sf_dir):
    """The niches of the tables that each element belongs to."""
    return niches.niche_matches(_elements(spark, sf_dir), niches.all_niches(spark)).select("ord", "niche", "relevant", "relaxed")


def build_candidates(spark, sf_dir):
    """Companies of each niche and location from elements and two more sources, with small thresholds for the small groups."""
    others = [D.on_spark(spark, sf_dir, text) for text in D.HITS.values()]
    return candidates.build_candidates(_elements(spark, sf_dir), others, [False, True], target=12, relaxed_min=6, catch_all_min=8)


def resolve_region(spark, sf_dir):
    places = D.on_spark(spark, sf_dir, D.GAZETTEER)
    return candidates.resolve_region(places.select(F.col("name").alias("location")), places)


def infer_pattern(spark, sf_dir):
    rows = _contacts(spark, sf_dir).select(S.url_domain("website").alias("domain"), F.explode(S.split_emails("all_emails_found")).alias("email"))
    return harvest.infer_patterns(rows.select("domain", F.lower("email").alias("email")))


def address_from_pattern(spark, sf_dir):
    rows = _contacts(spark, sf_dir).select("ord", "contact_person", S.url_domain("website").alias("domain"), F.element_at(F.array(*map(F.lit, ("{first}.{last}", "{first}", "{first}_{last}", "{f}{last}"))), (F.col("ord") % 4 + 1).cast("int")).alias("pattern"))
    return rows.select("ord", S.address_from_pattern("contact_person", "domain", "pattern").alias("address"))


def render_text(spark, sf_dir):
    rows = D.table(spark, sf_dir, "conversations")
    text = S.render_template(F.lit("[{role}] {turn}: {text} {none}"), {"role": F.col("role"), "turn": F.col("turn"), "text": F.col("text"), "none": F.lit(None)})
    return rows.select("conv_id", "turn", text.alias("line"))


def run_summary(spark, sf_dir):
    rows = clean.judged(_contacts(spark, sf_dir))
    return rows.groupBy("niche").agg(F.count("*").alias("total"), F.count_if(F.size("kept") > 0).alias("with_emails"), F.sum(F.size("kept")).alias("total_emails"))


def location_slugs(spark, sf_dir):
    return _contacts(spark, sf_dir).select(S.slug(F.concat_ws(", ", "niche", "location")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


def contact_preview(spark, sf_dir):
    rows = _contacts(spark, sf_dir).select("ord", "company_name", "all_emails_found")
    return selection.preview(rows, "ord", 10, 24)


def _people_pages(spark, sf_dir):
    """Page bodies with a person and a title set into them, by the page's number."""
    pages = D.table(spark, sf_dir, "pages")
    person = F.expr("case page_id % 4 when 0 then '<p>Ann Lee, CEO of the firm</p>' when 1 then '<p>Managing Director John Doe</p>' when 2 then '<h3>Eva Klein</h3><p>Head of Sales</p>' else '<p>Our Team, founder</p>' end")
    mail = F.expr("concat('<a href=\"mailto:x\">info [at] site', cast(page_id as string), ' [dot] test</a> eva.klein@site', cast(page_id as string), '.test +49 (0)30 1234567')")
    return pages.select(F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit(".test")).alias("site"), F.lit(0).alias("page_ord"), F.concat("html", person, mail).alias("html"))


def people_extract(spark, sf_dir):
    rows = _people_pages(spark, sf_dir).select("site", F.posexplode(S.extract_people("html")).alias("pos", "p"))
    return rows.select("site", "pos", "p.score", "p.name", "p.title")


def harvest_pages(spark, sf_dir):
    return harvest.harvest_pages(_people_pages(spark, sf_dir)).withColumn("emails", S.join_emails("emails"))


def harvest_planned(spark, sf_dir):
    """Sites of several pages, of which their homes and usual paths lead to some."""
    store = D.on_spark(spark, sf_dir, D.STORE)
    return harvest.harvest_planned(store.select("site", F.col("site").alias("url")).distinct(), store).withColumn("emails", S.join_emails("emails"))


def page_plan_hinted(spark, sf_dir):
    return harvest.page_plan(D.table(spark, sf_dir, "pages"))


def page_plan(spark, sf_dir):
    return harvest.page_plan(D.table(spark, sf_dir, "pages"), hints=())


#: Result links set before a page's own content.
RESULT_PAGE = "concat('<h3><a href=\"', url, '\">A &amp; B ', cast(page_id as string), '</a></h3><h3><a href=\"https://www.yelp.com/x\">no</a></h3><a class=\"result__a\" href=\"//r.test/?uddg=https%3A%2F%2Fother', cast(page_id div 5 as string), '.test%2Fp\">Other</a>', html)"


def result_links(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").select(F.lit("it").alias("query"), F.expr("cast(page_id div 10 as string)").alias("location"), F.expr(RESULT_PAGE).alias("html"))
    return harvest.result_links(pages)


def place_rows(spark, sf_dir):
    part = "named_struct('www', array(named_struct('value', 'ftp://x'), named_struct('value', concat('https://p', cast(p_partkey as string), '.test'))), 'phone', array(named_struct('value', ''), named_struct('value', cast(p_partkey as string))))"
    rows = D.table(spark, sf_dir, "part").select(F.expr("cast(p_partkey div 2 as string)").alias("id"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_name")).alias("title"), F.expr(f"array({part})").alias("contacts"))
    return sources.place_rows(rows)


def run_locations(spark, sf_dir):
    """Planned locations joined with cleaned, deduplicated and limited contacts."""
    cities = selection.plan_locations(D.on_spark(spark, sf_dir, D.NATION_CITIES), D.on_spark(spark, sf_dir, D.NATION_OUTPUTS))
    rows = dedup.dedup_companies(clean.clean_contacts(_contacts(spark, sf_dir)), ["ord"])
    return dedup.limit_per_group(rows.join(cities.select(F.col("city").alias("location")), "location"), ["niche", "location"], 20, ["source", "ord"]).select("niche", "location", "ord", "company_name", "contact_email")


def run_all_locations(spark, sf_dir):
    """Contact rows of every location of the elements that has no output yet, from candidates and saved pages."""
    elements = _elements(spark, sf_dir)
    cities = elements.groupBy(F.col("location").alias("city")).agg(F.min("ord").alias("ord")).select("ord", "city")
    outputs = D.on_spark(spark, sf_dir, "select distinct concat('city', cast(s_suppkey * 7 + 3 as string)) as location from {supplier}")
    pages = _people_pages(spark, sf_dir).withColumns({"page_ord": F.regexp_extract("site", r"(\d+)", 1).cast("long"), "site": F.regexp_replace("site", "^site", "p")})
    founders = D.on_spark(spark, sf_dir, "select p_name as company_name, concat('Mia ', case when p_partkey % 2 = 0 then 'Stone' else 'Field' end) as person, 'Founder' as title from {part}")
    others = [D.on_spark(spark, sf_dir, text) for text in D.HITS.values()]
    return locations.run_all_locations(cities, outputs, elements, others, [False, True], pages, founders, per_group=20, target=12, relaxed_min=6, catch_all_min=8)


def run_all_located(spark, sf_dir):
    """Contact rows of every twentieth place: elements by their coordinates and what they are, pages by each company's plan, founders from saved result pages."""
    places, points = D.on_spark(spark, sf_dir, D.GAZETTEER), D.on_spark(spark, sf_dir, D.POINTS).select("ord", "lat", "lon")
    elements = _elements(spark, sf_dir).drop("niche", "location", "lat", "lon").join(points, "ord")
    cities = D.on_spark(spark, sf_dir, "select c_custkey as ord, concat('Place ', cast(c_custkey as string)) as city from {customer}")
    outputs = D.on_spark(spark, sf_dir, "select distinct concat('Place ', cast(s_suppkey * 40 as string)) as location from {supplier}")
    asked = spark.createDataFrame([("it",), ("bakery",), ("data, cloud",), ("fitness gym",)], "niche string")
    others, mentions = [D.on_spark(spark, sf_dir, text) for text in D.PLACE_HITS.values()], D.on_spark(spark, sf_dir, D.NAME_MENTIONS)
    return locations.run_all_locations(
        cities, outputs, elements, others, [False, True], D.on_spark(spark, sf_dir, D.ELEMENT_STORE), per_group=20, slices={"k": 1, "n": 20}, gazetteer=places, niches=asked, founder_pages=mentions,
        target=12, relaxed_min=6, catch_all_min=8,
    )


def founders_of_pages(spark, sf_dir):
    return harvest.founders_of_pages(D.on_spark(spark, sf_dir, D.MENTIONS), D.on_spark(spark, sf_dir, D.FIRMS))


def second_search(spark, sf_dir):
    """Companies of a first search's pages, and of a second one's where the first gives few."""
    first, second = (candidates.linked_source(harvest.result_links(D.on_spark(spark, sf_dir, text)), name, mark) for text, name, mark in ((D.RESULT_PAGES, "Google", "g"), (D.SECOND_PAGES, "DuckDuckGo", "d")))
    return first.unionByName(candidates.second_search(first, second, least=6)).select("niche", "location", "id", "name", "website", "source")


def clean_stream(spark, sf_dir):
    """Contacts written as files, cleaned by the stream, and read again."""
    at = new_path(spark, "clean")
    _contacts(spark, sf_dir).write.parquet(f"{at}/in")
    stream = streams.contact_stream(spark, f"{at}/in", _contacts(spark, sf_dir).schema)
    streams.clean_contacts_stream(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("ord", "company_name", "contact_email", "all_emails_found")


def suppress_stream(spark, sf_dir):
    """Events as a stream of addresses, without those in the log and without repeats."""
    at = new_path(spark, "suppress")
    events = D.table(spark, sf_dir, "events").select("ts", F.concat(F.lit("info@co"), (F.col("user_id") * 3).cast("string"), F.lit(".test")).alias("email"))
    events.write.parquet(f"{at}/in")
    stream = streams.contact_stream(spark, f"{at}/in", "ts timestamp, email string")
    fresh = streams.suppress_repeats_stream(stream, D.on_spark(spark, sf_dir, D.LOG), delay="3650 days")
    fresh.select("email").writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(T.StructType([T.StructField("email", T.StringType())])).parquet(f"{at}/out")


def clean_file_stream(spark, sf_dir):
    """Contacts as CSV files of two layouts, arriving one after the other, cleaned by the stream and read again."""
    at, rows = new_path(spark, "layouts"), _contacts(spark, sf_dir)
    new = rows.where("ord % 2 = 0").select(*[F.col(n).alias(h) for n, h in C.CONTACT_COLUMNS.items() if n in rows.columns])
    old = rows.where("ord % 2 = 1").select(F.col("company_name").alias("name"), "website", F.col("all_emails_found").alias("emails"))
    for part in (new, old):
        part.write.mode("append").option("header", True).option("escape", '"').csv(f"{at}/in")
        streams.contact_file_stream(spark, f"{at}/in", f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("company_name", "contact_email", "all_emails_found")


def suppress_expiring(spark, sf_dir):
    """Addresses of events by the week and then some old ones: kept once a day of event time, the old ones apart."""
    at = new_path(spark, "expiring")
    events = D.table(spark, sf_dir, "events").select("ts", "event_id", F.concat(F.lit("Info@co"), F.col("user_id").cast("string"), F.lit(".test ")).alias("email"), F.expr("dayofmonth(ts) div 8").alias("week"))
    delayed = F.expr("event_id % 10 = 3 and week < 2")
    for part in [~delayed & (F.col("week") == i) for i in range(4)] + [delayed]:
        events.where(part).select("ts", "email").write.mode("append").parquet(f"{at}/in")
        stream = streams.contact_stream(spark, f"{at}/in", "ts timestamp, email string", files_per_trigger=10_000)
        streams.suppress_with_expiry_stream(stream, f"{at}/out", f"{at}/state").awaitTermination()
    both = [spark.read.parquet(f"{at}/out/{kind}").select("email_key", F.unix_micros("at").alias("at"), F.lit(kind == "late").alias("late")) for kind in ("kept", "late")]
    return both[0].unionByName(both[1])


def processed_log_stream(spark, sf_dir):
    """Orders' customers appended to a processed log by a stream."""
    at = new_path(spark, "log")
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.concat(F.lit("info@co"), F.col("o_custkey").cast("string"), F.lit(".test")).alias("recipient_email"))
    orders.write.parquet(f"{at}/in")
    stream = streams.contact_stream(spark, f"{at}/in", orders.schema, files_per_trigger=2)
    streams.log_stream(stream, f"{at}/log", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/log").groupBy("recipient_email").agg(F.count("*").alias("n"))


QUERIES = (
    email_domains, extract_emails, email_validity, extract_phones, html_text, page_links, url_normalise, rank_emails, collect_row_emails, clean_contacts,
    clean_contacts_strict, clean_summary, removed_emails, dedup_companies, mx_summary, verify_contacts, verify_counts, select_contacts, chunk_locations,
    plan_locations, limit_per_group, fill_to_quota, threshold_fallback, niche_relevance, element_search, candidate_skips, merge_sources, merge_sources_greedy, located_elements, niche_matches, build_candidates, resolve_region,
    infer_pattern, address_from_pattern, render_text, run_summary, location_slugs, contact_preview, people_extract, harvest_pages, harvest_planned, page_plan, page_plan_hinted, result_links, place_rows,
    run_locations, run_all_locations, run_all_located, founders_of_pages, second_search, clean_stream, suppress_stream, clean_file_stream, suppress_expiring, processed_log_stream,
)
