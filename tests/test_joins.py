"""Joins and merges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cardfile.operators import candidates, harvest, niches, spatial
from cardfile.operators.locations import run_all_locations, run_to_folder


@pytest.mark.parametrize("dense", [3, 100_000])
def test_points_lie_in_their_boxes(spark, dense):
    rng = random.Random(1)
    points = [(i, rng.choice([None, 0.0, rng.uniform(-90, 90), rng.gauss(48.85, 0.01)]), rng.choice([0.0, rng.uniform(-180, 180), rng.gauss(2.35, 0.01)])) for i in range(400)]
    boxes = [("world", -90.0, 90.0, -180.0, 180.0), ("origin", 0.0, 0.0, 0.0, 0.0), ("paris", 48.84, 48.86, 2.34, 2.36), ("turned", 10.0, -10.0, 0.0, 5.0), ("wide", -1.0, 1.0, -170.0, 170.0)]
    boxes += [(f"b{i}", *sorted((rng.uniform(-80, 80), rng.uniform(-80, 80))), *sorted((rng.uniform(-170, 170), rng.uniform(-170, 170)))) for i in range(10)]
    table = spark.createDataFrame(points, "ord long, lat double, lon double").withColumn("location", F.lit("clash"))
    regions = spark.createDataFrame(boxes, "location string, south double, north double, west double, east double")
    found = sorted((r.ord, r.location) for r in spatial.located(table, regions, dense=dense).collect())
    assert found == sorted((i, n) for i, lat, lon in points for n, s, t, w, e in boxes if lat is not None and s <= lat <= t and w <= lon <= e)
    assert spatial.located(table, regions.limit(0)).isEmpty() and spatial.located(table.limit(0), regions).isEmpty()


def test_niches_of_odd_elements(spark):
    rows = [(1, None, None), (2, "", {"office": "IT"}), (3, "IT-Haus", {}), (4, "Fitness", {}), (5, "Acme Coffee Shop", None), (6, "été web design", {"shop": None}), (7, "Anything", {"office": "company"}), (7, "Anything", {"office": "company"})]
    table = spark.createDataFrame(rows, "ord long, name string, tags map<string,string>")
    found = {(r.ord, r.niche) for r in niches.niche_matches(table, niches.all_niches(spark)).where("relevant").collect()}
    assert {(2, "it"), (3, "it"), (4, "fitness"), (5, "coffee shop"), (6, "web design")} <= found
    assert not {n for i, n in found if i in (1, 7)} and (4, "it") not in found
    assert niches.niche_matches(table.limit(0), niches.all_niches(spark)).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_greedy_merge_is_one_pass(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "abc", "bc", "b", "cab", "xbcx", " ABC ", "zz", "q", "zzq", "qz"])
    sources = [[(rng.choice("uv"), f"{k}{i:03}", " ".join(word() for _ in range(rng.choice([1, 1, 2]))), rng.choice(["https://a.test", "https://www.b.test/x", "https://c.test", None]), k) for i in range(40)] for k in "xyz"]
    by_host = [False, False, True]
    kept = []
    for rows, host_too in zip(sources, by_host):
        seen = set()
        earlier = bool(kept) or rows is not sources[0]
        for g, i, name, site, _ in rows:
            key, host = name.strip().lower(), (site or "").removeprefix("https://").removeprefix("www.").split("/")[0]
            if (g, key) in seen:
                continue
            seen.add((g, key))
            if not any(g == h and (key in k or k in key or (host_too and earlier and host and host == o)) for h, k, o, _ in kept):
                kept.append((g, key, host, i))
    tables = [spark.createDataFrame(rows, "g string, id string, name string, website string, source string") for rows in sources]
    found = candidates.merge_sources(tables, by_host, ("g",), greedy=True)
    assert sorted(r.id for r in found.collect()) == sorted(i for *_, i in kept)
    assert {r.name for r in found.collect()} <= {name for rows in sources for _, _, name, _, _ in rows}


def test_names_within_names(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("ab ") for _ in range(rng.choice([1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(150)} | {"", "\u00e4\U0001f600b", "x\u00e4\U0001f600bx", "shop 1", "shop 12", "shop 123"})
    rows = [(g, f"{g}{i}", n) for g in "uv" for i, n in enumerate(names) if g == "u" or i % 3]
    table = spark.createDataFrame(rows, "g string, id string, name string")
    want = {(i, j) for g, i, n in rows for h, j, o in rows if g == h and (n in o or o in n)}
    other = spark.createDataFrame(rows, "g string, id string, name string")
    for old in (table, other):
        assert {tuple(r) for r in candidates.same_names(table, old, ("g",)).collect()} == want
    # names are never sent to all executors, and meet on pieces of half their length or more
    assert "BroadcastHashJoin" not in candidates.same_names(table, table, ("g",))._jdf.queryExecution().executedPlan().toString()
    assert {r.n for r in table.where("length(name) = 40").select(candidates._gram_length("name").alias("n")).collect()} == {32}


def test_names_are_kept_as_given(spark):
    rows = [("1", " ACME Ltd ", "https://a.test", "OSM"), ("2", "acme ltd", "https://b.test", "OSM"), ("3", "McBee", None, "OSM")]
    for greedy in (False, True):
        found = candidates.merge_sources([spark.createDataFrame(rows, "id string, name string, website string, source string")], [False], greedy=greedy)
        assert {r.name for r in found.collect()} == {" ACME Ltd ", "McBee"}


def _store(spark):
    pages = [
        ("https://a.test/", '<a href="/who/team">People</a><a href="https://b.test/contact">contact</a> home@a.test'), ("http://A.test/who/team/", '<a href="/deep/contact-desk">x</a><p>Ann Lee, CEO</p>'),
        ("https://a.test/deep/contact-desk", "desk@a.test +1 415 555 0100"), ("https://a.test/contact", "c@a.test"), ("https://a.test/hidden", "hidden@a.test"), ("https://b.test/about", "b@b.test"), (None, "nobody@a.test"),
    ]
    return spark.createDataFrame(pages, "url string, html string")


def test_planned_pages(spark):
    homes = spark.createDataFrame([("a.test", "a.test"), ("a.test", "https://a.test/"), ("b.test", "https://b.test"), ("c.test", "https://c.test"), ("d", "")], "site string, url string")
    pages = harvest.planned_pages(homes, _store(spark))
    got = {(r.site, r.html.split(" ")[-1]): r.page_ord for r in pages.collect()}
    assert set(got) == {("a.test", "home@a.test"), ("a.test", "CEO</p>"), ("a.test", "c@a.test"), ("b.test", "b@b.test")} and got["a.test", "home@a.test"] == 0 and got["a.test", "CEO</p>"] == 1
    deeper = {r.html for r in harvest.planned_pages(homes, _store(spark), hops=2, max_pages=100).collect()}
    assert any("desk@a.test" in h for h in deeper) and not any("hidden" in h or "nobody" in h for h in deeper)
    assert {r.page_ord for r in harvest.planned_pages(homes, _store(spark), max_pages=1).where("site = 'a.test'").collect()} == {0, 1}
    sites = {r.site: r for r in harvest.harvest_planned(homes, _store(spark), hops=2, max_pages=100).collect()}
    assert sites["a.test"].contact_person == "Ann Lee" and sites["a.test"].phone_number == "+14155550100" and "desk@a.test" in sites["a.test"].emails


def test_pages_go_to_python_in_small_batches(spark):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "10000")
    try:
        harvest.harvest_planned(spark.createDataFrame([("a.test", "a.test")], "site string, url string"), _store(spark))
        assert int(spark.conf.get(rows)) <= 1_000
    finally:
        spark.conf.set(rows, before)


def test_founders_near_a_mention(spark):
    pages = [("<p>The ACME Ltd. was founded by Mia Stone, Founder.</p>",), ("<p>Acme Ltd: Bo Field, Manager</p>",), ("<p>XAcme Ltd, John Doe, CEO</p>",), (None,), ("<p>Acme Ltd</p>" + "<p>filler words</p>" * 60 + "<p>Eva Klein, CEO</p>",)]
    companies = spark.createDataFrame([("acme ltd",), ("Acme Ltd",), ("Nobody Inc",), ("",), (None,)], "company_name string")
    found = harvest.founders_of_pages(spark.createDataFrame(pages, "html string"), companies).collect()
    assert [(r.company_name, r.person, r.title) for r in found] == [("acme ltd", "Mia Stone", "Founder")]


def test_texts_meet_companies_once(spark):
    rng = random.Random(4)
    pages = spark.createDataFrame([(f"<p>Acme {i} Ltd: Bo Field, Manager</p>" + " ".join(f"w{rng.randrange(10**9)}" for _ in range(300)),) for i in range(30)] * 2, "html string")
    found = harvest.founders_of_pages(pages, spark.createDataFrame([(f"Acme {i} Ltd",) for i in range(0, 60, 2)], "company_name string"))
    assert {r.company_name for r in found.collect()} == {f"acme {i} ltd" for i in range(0, 30, 2)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode(array_distinct(regexp_extract_all(lower(text" in line]
    assert exploded and all("[0], false" in line for line in exploded)  # the text itself is not repeated for each word


def test_second_search_fills_small_groups(spark):
    rows = lambda mark, groups: spark.createDataFrame([("it", g, f"{mark}{i}") for g, n in groups for i in range(n)], "niche string, location string, id string")
    found = candidates.second_search(rows("g", [("A", 5), ("B", 2)]), rows("d", [("A", 1), ("B", 1), ("C", 1)]), least=5)
    assert sorted(r.location for r in found.collect()) == ["B", "C"]


def test_a_run_to_folders_tells_what_it_wrote(spark, tmp_path):
    gazetteer = spark.createDataFrame([("Town", "Town, Land", "city", 0.0, 1.0, 0.0, 1.0), ("Far", "Far, Land", "city", 50.0, 51.0, 0.0, 1.0)], "name string, display_name string, osm_type string, south double, north double, west double, east double")
    cities, outputs = spark.createDataFrame([(1, "Town"), (2, "Far")], "ord long, city string"), spark.createDataFrame([("Far",)], "location string")
    tags = [{"name": "IT Alpha", "website": "a.test", "office": "it"}, {"name": "Data Beta", "website": "b.test"}, {"name": "IT None", "office": "it"}, {"website": "x.test", "office": "it"}, {"name": "Tech Gamma", "website": "g.test"}, {"name": "IT Far", "website": "far.test", "office": "it"}]
    elements = spark.createDataFrame([("node", i, i, 50.5 if i == 5 else 0.5, 0.5, t) for i, t in enumerate(tags)], "type string, id long, ord long, lat double, lon double, tags map<string,string>")
    path = f"file://{tmp_path}/out"
    inputs = (cities, outputs, elements, [], [], _store(spark))
    settings = {"gazetteer": gazetteer, "niches": spark.createDataFrame([("it",)], "niche string"), "founder_pages": spark.createDataFrame([("<p>Data Beta, Mia Stone, Founder</p>",)], "html string")}
    summary = run_to_folder(path, *inputs, **settings)
    back = spark.read.option("header", True).csv(path)
    rows = {r["Company Name"]: r for r in back.collect()}
    assert set(rows) == {"IT Alpha", "Data Beta"} and {r["location"] for r in rows.values()} == {"Town"}
    assert (summary["rows"], summary["with_emails"], summary["total_emails"]) == (2, 2, sum(len(r["All Emails Found"].split("; ")) for r in rows.values()))
    assert summary["skipped"] == {"no name": 1, "no website": 1, "not relevant": 0, "no valid email": 1}
    assert rows["Data Beta"]["Founder Source"] == "search" and rows["Data Beta"]["Contact Person"] == "Mia Stone"
    again = run_all_locations(*inputs, **settings)
    assert {r.company_name for r in again.collect()} == set(rows)


@pytest.mark.parametrize("listed, given", [(1, 1), (3, 20), (1_000, 1 << 26)])
def test_places_of_one_box_are_listed_after_the_last_shuffle(spark, listed, given):
    points = [(i, float(i % 7), float(i % 5)) for i in range(60)] + [(0, 0.0, 0.0)] * 2
    boxes = [(f"a{i}", 0.0, 3.0, -0.0 if i % 2 else 0.0, 2.0) for i in range(25)] + [(f"b{i}", 2.0, 6.0, 1.0, 4.0) for i in range(10)] + [("a0", 5.0, 6.0, 0.0, 4.0), ("a0", 0.0, 3.0, 0.0, 2.0)]
    table = spark.createDataFrame(points, "ord long, lat double, lon double")
    regions = spark.createDataFrame(boxes, "location string, south double, north double, west double, east double")
    found = spatial.located(table, regions, dense=10, listed=listed, given=given)
    distinct = {(n, s, t, w + 0.0, e) for n, s, t, w, e in boxes}
    assert sorted((r.ord, r.location) for r in found.collect()) == sorted((i, n) for i, lat, lon in points for n, s, t, w, e in distinct if s <= lat <= t and w <= lon <= e)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("explode(_locations" in line for line in plan[:2])  # nothing of the size of the result is shuffled


@pytest.mark.parametrize("held_cells", [0, 1 << 17])
def test_locations_go_to_a_bounded_number_of_parts(spark, held_cells):
    points, boxes = [(i, i % 40 / 10, i % 23 / 10) for i in range(2000)], [(f"a{i}", 0.0, 3.0, 0.0, 2.0) for i in range(60)] + [(f"b{i}", 1.0, 2.0, 0.5, 1.5) for i in range(9)]
    table = spark.createDataFrame(points, "ord long, lat double, lon double")
    regions = spark.createDataFrame(boxes, "location string, south double, north double, west double, east double")
    found = spatial.located(table, regions, given=1, held_cells=held_cells)
    assert sorted((r.ord, r.location) for r in found.collect()) == sorted((i, n) for i, lat, lon in points for n, s, t, w, e in boxes if s <= lat <= t and w <= lon <= e)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ("hashpartitioning(_level" in plan) == (held_cells == 0)  # few cells are looked up where the points are
    rows, spread = found.count(), [line for line in plan.splitlines() if "explode(sequence(0, (_parts" in line]
    assert rows > 50_000 and spread
    copied = spatial._dealt_boxes(regions.select(F.col("south").alias("_box")), table.select(F.lit(0.0).alias("_box")), 1_000, 1, 100).collect()
    assert [(r._lists, r._parts) for r in copied] == [(1, 100)]  # not a part for each of its 120,000 rows


def test_niches_of_elements_equal_the_rules_of_each_pair(spark):
    rows = [(i, f"{p} {i}", {"office": "IT"} if i % 3 == 0 else {"a=b": "c", "shop": None}) for i, p in enumerate(["Acme Software", "x c# z", "IT", "it-haus", "", "Web  Design", "web design", "ab", "Bäckerei & Café", None] * 3)]
    table = spark.createDataFrame(rows, "ord long, name string, tags map<string,string>")
    asked = spark.createDataFrame([("it",), ("web design",), ("b2",), ("coffee shop",)], "niche string")
    tables = {"terms": {"b2": ("c#", "ab", "cloud", "software"), "it": ("software",)}}
    found = niches.niche_matches(table, asked, **tables)
    every = candidates.judged(table.crossJoin(asked), name="name", **tables).where("relevant or relaxed")
    key = lambda r: (r.ord, r.niche, r.relevant, r.relaxed)
    assert sorted(map(key, found.collect())) == sorted(map(key, every.collect())) and not found.isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan  # rows are dealt once, before their keys are listed, and what is found is not shuffled
    assert not any("hashpartitioning" in line and "relevant#" in line for line in plan.splitlines())


def test_places_of_one_box_share_their_candidates(spark, monkeypatch):
    from pyspark.sql import Observation

    from cardfile.operators import locations

    near, small, far = (0.0, 1.0, 0.0, 1.0), (0.5, 1.0, 0.0, 1.0), (50.0, 51.0, 0.0, 1.0)
    boxes = [("A", near), ("B", near), ("C", near), ("D", small), ("E", small), ("E", far)]
    gazetteer = spark.createDataFrame([(n, f"{n}, Land", "city", *b) for n, b in boxes], "name string, display_name string, osm_type string, south double, north double, west double, east double")
    cities, outputs = spark.createDataFrame(list(enumerate("ABCDEF")), "ord long, city string"), spark.createDataFrame([], "location string")
    points = [("IT Alpha", "a.test", 0.1), ("IT Beta", "b.test", 0.2), ("IT Gamma", "g.test", 0.7), ("IT Delta", "d.test", 50.5)]
    elements = spark.createDataFrame([("node", i, i, lat, 0.5, {"name": n, "website": s, "office": "it"}) for i, (n, s, lat) in enumerate(points)], "type string, id long, ord long, lat double, lon double, tags map<string,string>")
    hits = [("A", "it alpha", "x.test"), ("B", "New One", "n.test"), ("D", "IT Alpha", "a.test"), ("D", "Host Twin", "g.test"), ("F", "IT Alpha", "a.test"), ("F", "IT Alpha Ltd", "l.test")]
    hits = spark.createDataFrame([("it", p, f"h{i}", n, f"https://{s}", "HERE") for i, (p, n, s) in enumerate(hits)], "niche string, location string, id string, name string, website string, source string")
    pages = spark.createDataFrame([(f"{k}.test", 0, f"info@{k}.test") for k in "abgdnlx"], "site string, page_ord int, html string")
    placed, once = [], locations.element_candidates
    monkeypatch.setattr(locations, "element_candidates", lambda rows, *more, **named: placed.append(rows.count()) or once(rows, *more, **named))
    watch = {k: Observation(k) for k in ("found", "harvested")}
    found = locations.run_all_locations(cities, outputs, elements, [hits], [True], pages, per_group=3, gazetteer=gazetteer, niches=spark.createDataFrame([("it",)], "niche string"), watch=watch)
    rows = sorted((r.location, r.company_name, r.source) for r in found.collect())
    own = lambda place, *names: [(place, f"IT {n}", "OSM") for n in names]
    want = [x for p in "ABC" for x in own(p, "Alpha", "Beta", "Gamma")] + [("D", "IT Alpha", "HERE"), *own("D", "Gamma"), *own("E", "Delta", "Gamma"), ("F", "IT Alpha", "HERE")]
    assert rows == want
    assert placed == [6]  # rows of three areas, not of five places
    assert watch["found"].get["elements"] == 12 and watch["harvested"].get == {"companies": 15, "no_valid_email": 0}
