"""Addresses, phones and people of each site's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardfile.functions import constants as C
from cardfile.functions import scalars as S
from cardfile.operators.clean import first_personal_email
from cardfile.sources.store import text_batches

MAX_PAGES = 15


def page_plan(homes: DataFrame, max_pages: int = MAX_PAGES, hints=C.CONTACT_HINTS) -> DataFrame:
    """(page_id, url, rank): home, then hinted links of its host, then fixed paths; distinct, max_pages + 1 at most."""
    links = homes.select("page_id", F.col("url").alias("base"), F.posexplode(S.hinted_anchors("html", hints)).alias("pos", "a"))
    links = links.select("page_id", F.regexp_replace(S.url_join("base", "a.href"), "/+$", "").alias("url"), "base", "pos").where(S.url_host("url") == S.url_host("base"))
    paths = homes.select("page_id", F.posexplode(S.candidate_page_urls("url")).alias("pos", "url"))
    every = homes.select("page_id", S.normalize_url("url").alias("url"), F.lit(0).alias("kind"), F.lit(0).alias("pos"))
    every = every.unionByName(links.select("page_id", "url", F.lit(1).alias("kind"), "pos")).unionByName(paths.select("page_id", "url", F.lit(2).alias("kind"), "pos"))
    first = every.groupBy("page_id", "url").agg(F.min(F.struct("kind", "pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("at.kind", "at.pos", "url"))
    return first.withColumn("rank", rank).where(F.col("rank") <= max_pages + 1).select("page_id", "url", "rank")


def scraped(pages: DataFrame) -> DataFrame:
    """pages (site, page_ord, html) with emails, phones and people."""
    return text_batches(pages).select("site", "page_ord", S.extract_emails("html").alias("emails"), S.extract_phones("html").alias("phones"), S.extract_people("html").alias("people"))


def harvest_pages(pages: DataFrame, junk=C.JUNK_PATTERNS) -> DataFrame:
    """One row per site: emails in order of relevance, phone, person, contact address, and a guess for the person.

    Pages are scraped once: what they give becomes tagged rows, of which each
    task keeps a site's distinct addresses, first phone and best person before
    anything is shuffled. Observed addresses are never replaced by guessed ones.
    """
    none = lambda kind: F.lit(None).cast(kind)
    place, person_of = "struct<page_ord:long,pos:int,phone:string>", "struct<score:int,name:string,title:string>"
    found = lambda email, phone, person: F.struct(email.alias("email"), phone.alias("phone"), person.alias("person"))
    tagged = F.concat(
        F.array(found(none("string"), none(place), none(person_of))),  # a site that gives nothing has a row too
        F.transform("emails", lambda e: found(e, none(place), none(person_of))),
        F.transform("phones", lambda p, i: found(none("string"), F.struct(F.col("page_ord").cast("long").alias("page_ord"), i.alias("pos"), p.alias("phone")), none(person_of))),
        F.transform("people", lambda p: found(none("string"), none(place), F.struct(p["score"].cast("int").alias("score"), p["name"].alias("name"), p["title"].alias("title")))),
    )
    rows = scraped(pages).select("site", F.explode(tagged).alias("x")).select("site", "x.*")
    kept = rows.where(F.col("email").isNull() | S.is_valid_target_email("email", junk=junk))
    sites = kept.groupBy("site").agg(S.sort_emails(F.collect_set("email")).alias("emails"), F.min("phone").alias("phone"), F.min("person").alias("person")).withColumn("phone_number", F.col("phone.phone"))
    pattern = F.when(F.exists("emails", lambda e: S.email_domain(e) == F.col("site")), F.coalesce(F.get(F.filter(F.transform(F.filter("emails", lambda e: (S.email_domain(e) == F.col("site")) & ~S.email_local(e).isin(*C.GENERIC_LOCALS)), lambda e: S.email_pattern(S.email_local(e))), lambda p: p.isNotNull()), F.lit(0)), F.lit("{first}.{last}")))
    person = F.coalesce(F.col("person.name"), F.lit(""))
    return sites.select(
        "site", F.coalesce("emails", F.array().cast("array<string>")).alias("emails"), F.coalesce("phone_number", F.lit("")).alias("phone_number"), person.alias("contact_person"),
        F.coalesce("person.title", F.lit("")).alias("contact_title"), F.coalesce(first_personal_email("emails"), F.lit("")).alias("contact_email"),
        F.when((person != "") & pattern.isNotNull(), S.address_from_pattern(person, "site", pattern)).alias("contact_email_inferred"), S.founder_source(person != "", F.lit(True)).alias("founder_source"),
    )


def page_key(url):
    """What two addresses of one page have in common: no scheme, fragment or trailing slash, the host in lower case."""
    plain = F.regexp_replace(F.regexp_replace(S.normalize_url(url), "#.*$", ""), "/+$", "")
    return F.concat(S.url_host(plain), F.regexp_extract(plain, "^https?://[^/?#]+(.*)$", 1))


def planned_pages(homes: DataFrame, store: DataFrame, hops: int = 1, max_pages: int = MAX_PAGES, hints=C.CONTACT_HINTS) -> DataFrame:
    """(site, page_ord, html): the stored pages that each site's plan takes, home first.

    homes: site and url; store: url and html of any pages. The plan is the home,
    its hinted links, then the fixed paths, max_pages + 1 addresses at most,
    whether stored or not; each further hop adds the hinted links of the pages that the
    one before brought, as far as there is room. Plans and pages are joined by
    page_key, so nothing but planned pages is ever read for more than its address; of pages
    stored under one key the first by address counts.
    """
    first = store.where(F.col("url").isNotNull()).groupBy(page_key("url").alias("key")).agg(F.min_by("html", "url").alias("html"))
    asked = homes.select("site", F.concat(F.regexp_replace(S.normalize_url("url"), "/+$", ""), F.lit("/")).alias("url")).where("url <> '/'")
    start = asked.groupBy("site").agg(F.min("url").alias("url")).withColumn("key", page_key("url")).join(first, "key", "left")
    plan = page_plan(start.select(F.col("site").alias("page_id"), "url", "html"), max_pages, hints).select(F.col("page_id").alias("site"), page_key("url").alias("key"), F.col("rank").cast("long").alias("rank"), "url")
    once = lambda df: df.groupBy("site", "key").agg(F.min(F.struct("rank", "url")).alias("x")).select("site", "key", "x.*")
    plan = once(plan)
    got = plan.join(first, "key")
    for _ in range(1, hops):
        links = got.select("site", F.col("url").alias("base"), "rank", F.posexplode(S.hinted_anchors("html", hints)).alias("pos", "a"))
        links = links.select("site", F.regexp_replace(S.url_join("base", "a.href"), "/+$", "").alias("url"), "base", F.struct("rank", "pos").alias("at")).where(S.url_host("url") == S.url_host("base"))
        new = links.withColumn("key", page_key("url")).groupBy("site", "key").agg(F.min(F.struct("at", "url")).alias("x")).join(plan.select("site", "key"), ["site", "key"], "left_anti")
        have = plan.groupBy("site").agg(F.max("rank").alias("most"))
        ranked = new.join(have, "site").withColumn("rank", F.col("most") + F.row_number().over(Window.partitionBy("site").orderBy("x"))).where(F.col("rank") <= max_pages + 1)
        more = ranked.select("site", "key", "rank", F.col("x.url").alias("url"))
        plan, got = plan.unionByName(more), got.unionByName(more.join(first, "key"))
    return got.select("site", (F.col("rank") - 1).alias("page_ord"), "html")


def harvest_planned(homes: DataFrame, store: DataFrame, hops: int = 1, max_pages: int = MAX_PAGES, hints=C.CONTACT_HINTS, junk=C.JUNK_PATTERNS) -> DataFrame:
    """harvest_pages over the stored pages that each site's plan takes."""
    return harvest_pages(planned_pages(homes, store, hops, max_pages, hints), junk)


def infer_patterns(emails: DataFrame) -> DataFrame:
    """(domain, pattern) of (domain, email) rows: the first personal address in order of relevance that shows one decides."""
    own = emails.where(S.email_domain("email") == F.lower("domain")).withColumn("local", S.email_local("email"))
    said = own.withColumn("pattern", F.when(~F.lower("local").isin(*C.GENERIC_LOCALS), S.email_pattern(F.col("local"))))
    order = F.struct(F.col("pattern").isNull(), ~S.is_preferred_email("email"), "email")
    return said.groupBy(F.lower("domain").alias("domain")).agg(F.coalesce(F.min_by("pattern", order), F.lit("{first}.{last}")).alias("pattern"))


def _letters(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def founders_of_pages(pages: DataFrame, companies: DataFrame, reach: int = 200) -> DataFrame:
    """(company_name, score, person, title): the person of the best rank named near a company's first mention in any page.

    pages: html; companies: company_name, repeats and case ignored, no letter or digit beside a mention.
    A text and a company meet on the word of its name that fewest texts hold, by the text's hash; each
    text is joined with its companies once, and the whole name decides. People are looked for in the `reach` characters on either side.
    """
    texts = pages.select(S.html_to_text("html").alias("text")).where("text <> ''").withColumn("key", F.xxhash64("text"))
    names = companies.select(F.lower(S.trimmed("company_name")).alias("company_name")).where("company_name <> ''").distinct()
    asked = names.select("company_name", F.explode(F.array_distinct(_letters(F.col("company_name")))).alias("word"))
    words = texts.select("key", F.explode(F.array_distinct(_letters(F.col("text")))).alias("word")).join(asked.select("word").distinct(), "word", "left_semi").distinct()
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "word", "left").groupBy("company_name").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    pairs = words.join(rarest, "word").select("key", "company_name")
    near = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), F.regexp_replace("company_name", r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}])"))
    once = texts.groupBy("key").agg(F.collect_set("text").alias("texts"))  # more than one only where two texts share a hash
    # whole texts never go through the driver, however well their shuffle compresses
    met = once.hint("merge").join(pairs, "key").select("company_name", F.explode("texts").alias("text")).withColumn("at", F.regexp_instr("text", near)).where("at > 0")
    start = F.greatest(F.col("at") - reach, F.lit(1))
    window = F.substr("text", start, F.col("at") - start + F.length("company_name") + reach)
    people = met.select("company_name", F.explode(S.extract_people(window)).alias("p"))
    best = people.groupBy("company_name").agg(F.min("p").alias("p"))
    return best.select("company_name", "p.score", F.col("p.name").alias("person"), "p.title")


def result_links(pages: DataFrame, hosts=C.SEARCH_HOSTS) -> DataFrame:
    """(query, location, pos, host, url, name) of saved result pages, one row a host: its least place in a page, then url and name."""
    pairs = [F.arrays_zip(F.regexp_extract_all("html", F.lit(f"(?is){p}"), 1).alias("href"), F.regexp_extract_all("html", F.lit(f"(?is){p}"), 2).alias("title")) for p in (C.RESULT_HEADING, C.RESULT_LINK)]
    rows = pages.select("query", "location", F.posexplode(F.concat(*pairs)).alias("pos", "x"))
    rows = rows.select("query", "location", "pos", S.unwrap_redirect("x.href").alias("url"), S.trimmed(S.html_unescape(F.regexp_replace("x.title", "<[^>]+>", ""))).alias("name"))
    rows = rows.withColumn("host", S.url_domain("url")).where((F.col("host") != "") & ~S.is_directory_host(F.col("host"), hosts))
    first = rows.groupBy("query", "location", "host").agg(F.min(F.struct("pos", "url", "name")).alias("x"))
    return first.select("query", "location", "x.pos", "host", "x.url", "x.name")
