"""From planned locations to contact rows: candidates, their pages' contacts, dedup and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cardfile.functions import constants as C
from cardfile.functions import scalars as S
from cardfile.operators.candidates import element_candidates, marked_elements, merge_sources, resolve_region
from cardfile.operators.dedup import first_of_each, limit_per_group
from cardfile.operators.harvest import founders_of_pages, harvest_pages, harvest_planned
from cardfile.operators.niches import niche_matches
from cardfile.operators.selection import plan_locations
from cardfile.operators.spatial import located
from cardfile.sources.store import cut
from cardfile.sources.tables import write_contacts


def areas_of(due: DataFrame, gazetteer: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(location, area) of each due location, and (area, south, north, west, east) of the areas' boxes.

    Locations of the same boxes have one area, those without a box have none. Without a gazetteer
    each location is its own area, and areas have no boxes.
    """
    places = due.select("location").distinct()
    if gazetteer is None:
        return cut(places.withColumn("area", F.col("location")), "places"), None
    sides = ["south", "north", "west", "east"]
    boxes = resolve_region(places, gazetteer).select("location", *[(F.col(c) + 0.0).alias(c) for c in sides]).where("south <= north and west <= east")
    named = boxes.groupBy("location").agg(F.sort_array(F.collect_set(F.array(*sides))).alias("boxes"))
    named = named.withColumn("area", F.concat_ws(";", F.transform("boxes", lambda b: F.array_join(b.cast("array<string>"), " "))))
    found = cut(places.join(named, "location", "left"), "places")
    each = found.select("area", "boxes").where("area is not null").distinct().select("area", F.explode("boxes").alias("b"))
    return found.select("location", "area"), each.select("area", *[F.col("b")[i].alias(c) for i, c in enumerate(sides)])


def placed_elements(elements: DataFrame, places: DataFrame, boxes: DataFrame | None = None, niches: DataFrame | None = None, rules: dict | None = None, **tables) -> DataFrame:
    """elements with area and niche: of their own location and niche, or by the areas' boxes that hold them and the niches that they match.

    places and boxes: as areas_of gives them. With boxes, elements have lat and lon, and one in several
    areas is a row of each. With niches, an element is a row of each niche that
    it matches, strictly or loosely, and marked by marked_elements (rules: its hosts and match).
    """
    rules = rules or {}
    if boxes is not None:
        rows = located(elements.drop("location"), boxes.withColumnRenamed("area", "location")).withColumnRenamed("location", "area")
    else:
        rows = elements.join(places, "location")
    if niches is not None:
        rows = cut(rows.drop("niche"), "placed")
        once = rows.select("ord", "type", "id", "tags").dropDuplicates(["ord"]).withColumn("_name", F.try_element_at("tags", F.lit("name")))
        matches = niche_matches(once, niches, name="_name", **tables).select("ord", "niche")
        # judged once for each niche, before it is a row of each area
        marked = marked_elements(once.drop("_name").join(matches, "ord"), **rules, **tables).drop("tags")
        rows = rows.select("ord", "area").join(marked, "ord")
    return rows


def run_all_locations(
    cities: DataFrame, outputs: DataFrame, elements: DataFrame, others: list[DataFrame], by_host: list[bool], pages: DataFrame, founders: DataFrame | None = None, per_group: int = 500, slices: dict | None = None,
    gazetteer: DataFrame | None = None, niches: DataFrame | None = None, founder_pages: DataFrame | None = None, hops: int = 1, watch: dict[str, Observation] | None = None, **settings,
) -> DataFrame:
    """(niche, location, the contact columns) of the locations that are due.

    cities and outputs: as in plan_locations, slices its skip, limit, k and n.
    elements, others, by_host and settings: as in build_candidates, with niche
    and location, or as placed_elements finds these by gazetteer and niches; locations of one
    box share their elements' candidates, of which the best per_group are listed for each at the end. pages: site,
    page_ord and html of pages to harvest, or url and html of a store, of which each
    company's plan takes some (hops as in planned_pages); either way only found companies' pages are read for more than their
    address. founders: company_name, person and title found by search, or founder_pages:
    saved result pages (html) to find them in; used where a site names nobody. Companies without a
    valid address are left out, a name and website counts once a niche and location, and
    such a group gives at most per_group rows, those of elements first. watch:
    observations for "found" and "harvested", as run_to_folder sets them.
    """
    watch = watch or {}
    due = plan_locations(cities, outputs, **(slices or {})).select(F.col("city").alias("location"))
    tables = {k: settings[k] for k in ("tags", "terms") if k in settings}
    places, boxes = areas_of(due, gazetteer)
    rules = {k: settings[k] for k in ("hosts", "match") if k in settings}
    here = placed_elements(elements.drop("area", "times"), places, boxes, niches, rules, **tables)
    greedy = settings.pop("greedy", False)
    times = places.groupBy("area").agg(F.count("*").alias("times"))
    shared = ["niche", "area"]
    own = cut(element_candidates(here.join(times, "area"), tuple(shared), watch=watch.get("found"), times="times", **settings), "own")
    later = merge_sources([df.drop("area").join(places, "location") for df in others], by_host, ("niche", "location"), greedy=greedy, base=own, base_groups=tuple(shared)) if others else None
    # a row has an area, for all its locations, or a location of its own
    found = own.join(times, "area").withColumns({"location": F.lit(None).cast("string"), "priority": F.lit(0)})
    if later is not None:
        found = found.unionByName(later.withColumns({"area": F.lit(None).cast("string"), "times": F.lit(1).cast("long")}))
    found = cut(found.withColumn("site", S.url_domain("website")), "found")
    if "page_ord" in pages.columns:
        sites = harvest_pages(pages.join(found.select("site").distinct(), "site", "left_semi"))
    else:
        homes = found.where("site <> ''").groupBy("site").agg(F.min("website").alias("url"))
        sites = harvest_planned(homes, pages, hops)
    rows = found.join(sites, "site", "left")
    if "harvested" in watch:
        rows = rows.observe(watch["harvested"], F.coalesce(F.sum("times"), F.lit(0)).alias("companies"), F.coalesce(F.sum(F.when(F.coalesce(F.size("emails"), F.lit(0)) <= 0, F.col("times"))), F.lit(0)).alias("no_valid_email"))
    rows = rows.where(F.size("emails") > 0)
    if founders is None and founder_pages is not None:
        founders = founders_of_pages(founder_pages, found.select(F.col("name").alias("company_name")))
    if founders is not None:
        person = F.struct(S.title_rank("title").alias("rank"), "person", "title")
        best = founders.groupBy(F.lower(S.trimmed("company_name")).alias("_name")).agg(F.min(person).alias("searched"))
        rows = rows.join(best, F.lower(S.trimmed("name")) == F.col("_name"), "left")
    else:
        rows = rows.withColumn("searched", F.lit(None).cast("struct<rank:int,person:string,title:string>"))
    own = F.col("contact_person") != ""
    by_search = ~own & F.col("searched").isNotNull()
    pattern = F.coalesce(F.get(F.filter(F.transform("emails", lambda e: F.when((S.email_domain(e) == F.col("site")) & ~S.email_local(e).isin(*C.GENERIC_LOCALS), S.email_pattern(S.email_local(e)))), lambda p: p.isNotNull()), F.lit(0)), F.lit("{first}.{last}"))
    guess = F.when(by_search, S.address_from_pattern("searched.person", "site", pattern)).otherwise(F.col("contact_email_inferred"))
    rows = rows.select(
        "niche", "area", "location", F.col("id").alias("ord"), "priority", F.col("name").alias("company_name"), "website", "source", "phone_number",
        F.when(by_search, F.col("searched.person")).otherwise(F.col("contact_person")).alias("contact_person"), F.when(by_search, F.col("searched.title")).otherwise(F.col("contact_title")).alias("contact_title"),
        "contact_email", S.founder_source(own | by_search, own).alias("founder_source"), S.join_emails("emails").alias("all_emails_found"), guess.alias("contact_email_inferred"),
    )
    order, listed = ["priority", "ord"], [F.lower(S.trimmed("company_name")).alias("_name"), F.lower(S.trimmed("website")).alias("_site")]
    # an area's best rows are those of each of its locations, so no more of them are listed
    best = limit_per_group(first_of_each(rows, ["niche", "area", "location", *listed], order), ["niche", "area", "location"], per_group, order)
    every = best.withColumnRenamed("location", "_own").join(places, "area", "left").withColumn("location", F.coalesce("_own", "location")).drop("_own", "area")
    once = first_of_each(every, ["niche", "location", *listed], order)
    return limit_per_group(once, ["niche", "location"], per_group, order).select("niche", "location", *C.CONTACT_COLUMNS, "contact_email_inferred")


def run_to_folder(path: str, *inputs, **settings) -> dict:
    """Writes what run_all_locations gives for these inputs, a folder for each niche and location, and returns the run's summary.

    rows, with_emails and total_emails of what is written, and skipped: elements
    without a name, without a website or not relevant, and companies without a valid address. All
    are observed in the passes that write, none by a count of its own. Other
    folders under path stay as they are.
    """
    watch = {k: Observation(k) for k in ("found", "harvested", "written")}
    rows = run_all_locations(*inputs, watch=watch, **settings)
    listed = F.when(F.col("all_emails_found") == "", 0).otherwise(F.size(F.split("all_emails_found", "; ")))
    watched = rows.observe(watch["written"], F.count("*").alias("rows"), F.count_if(F.col("all_emails_found") != "").alias("with_emails"), F.coalesce(F.sum(listed), F.lit(0)).alias("total_emails"))
    write_contacts(watched, path)
    found, harvested = watch["found"].get, watch["harvested"].get
    return watch["written"].get | {"skipped": {"no name": found["no_name"], "no website": found["no_website"], "not relevant": found["not_relevant"], "no valid email": harvested["no_valid_email"]}}
