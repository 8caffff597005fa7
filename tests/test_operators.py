"""Sources, properties and order of the operators."""

import pytest
from pyspark.sql import functions as F

from cardfile.operators import clean, dedup, selection
from cardfile.plans import derived as D
from cardfile.sources import tables as sources


@pytest.fixture(scope="module")
def contacts(spark, sf_dir):
    return D.on_spark(spark, sf_dir, D.CONTACTS).cache()


def test_contact_files_of_several_layouts(spark, tmp_path):
    bom = "﻿"
    (tmp_path / "a.csv").write_text(bom + 'Company Name,Website,Contact Email,All Emails Found\r\n"Acme, Inc",https://a.test, x@a.test ,"x@a.test; y@a.test"\r\n"Two\nLines",,,z@a.test\r\n', encoding="utf-8", newline="")
    (tmp_path / "b.csv").write_text(bom + "Company Name,WhatsApp Link,Website,Contact Email,All Emails Found\r\nBee,wa,https://b.test,,b@b.test\r\n", encoding="utf-8", newline="")
    (tmp_path / "old.csv").write_text("name,website,emails\nOld,old.test,o@old.test\n")
    (tmp_path / "sent_log.csv").write_text("name,website,emails\nNo,no.test,no@no.test\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    rows = sources.to_contact_schema(sources.read_contacts(spark, f"file://{tmp_path}"))
    found = {(r.file, r.company_name, r.website, r.contact_email, r.all_emails_found) for r in rows.collect()}
    assert found == {
        ("a.csv", "Acme, Inc", "https://a.test", "x@a.test", "x@a.test; y@a.test"), ("a.csv", "Two\nLines", "", "", "z@a.test"),
        ("b.csv", "Bee", "https://b.test", "", "b@b.test"), ("old.csv", "Old", "old.test", "", "o@old.test"),
    }


def test_cities(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# no\n\n 'Austin, Texas' \nBoston\n")
    assert [r.city for r in sources.read_cities(spark, f"file://{tmp_path}/c.txt").orderBy("ord").collect()] == ["Austin, Texas", "Boston"]


def test_written_contacts_replace_their_folders_only(spark, contacts, tmp_path):
    rows = contacts.withColumn("founder_source", F.lit("none"))
    path = f"file://{tmp_path}/out"
    sources.write_contacts(rows, path)
    before = spark.read.option("header", True).csv(path).count()
    one = rows.first()
    sources.write_contacts(rows.where((F.col("niche") == one.niche) & (F.col("location") == one.location)), path)
    assert before == rows.count() == spark.read.option("header", True).csv(path).count()


def test_cleaning_is_idempotent_and_partitions(contacts):
    lax, strict = clean.clean_contacts(contacts), clean.clean_contacts(contacts, True)
    assert clean.clean_contacts(lax).exceptAll(lax).isEmpty()
    total = clean.cleaning_summary(contacts, "location").where("location is null").first()
    assert total.rows_kept + total.rows_dropped == contacts.count() and total.rows_kept == lax.count()
    assert strict.select("ord").subtract(lax.select("ord")).isEmpty()


def test_chunks_partition_the_list(spark, contacts):
    parts = [selection.chunk(contacts, "ord", k, 4).select("ord") for k in (1, 2, 3, 4)]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    assert every.count() == contacts.count() == every.distinct().count()
    with pytest.raises(ValueError):
        selection.chunk(contacts, "ord", 5, 4)


def test_order_of_the_input_does_not_matter(contacts):
    once = dedup.dedup_companies(contacts, ["ord"])
    again = dedup.dedup_companies(contacts.repartition(7, "website"), ["ord"])
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()


def test_streams_need_no_llm():
    import cardfile.registry as registry

    assert "clean_stream" in registry.queries()


def test_all_locations_give_contact_rows(spark):
    from cardfile.operators.locations import run_all_locations

    cities = spark.createDataFrame([(1, "A"), (2, "B")], "ord long, city string")
    outputs = spark.createDataFrame([("B",)], "location string")
    tags = lambda name, site, **more: {"name": name, "website": site, "office": "it", **more}
    elements = [("it", p, "node", i, i, tags(n, s)) for i, (p, n, s) in enumerate([("A", "IT One", "one.test"), ("A", "IT One", "https://one.test/"), ("B", "IT Far", "far.test"), ("A", "IT Two", "two.test"), ("A", "IT None", "none.test")])]
    elements = spark.createDataFrame(elements, "niche string, location string, type string, id long, ord long, tags map<string,string>")
    hits = spark.createDataFrame([("it", "A", "h1", "it two", "https://x.test", "HERE"), ("it", "A", "h2", "Other", "https://o.test", "HERE")], "niche string, location string, id string, name string, website string, source string")
    pages = [("one.test", 0, "<p>Ann Lee, CEO</p> info@one.test +1 415 555 0100"), ("two.test", 0, "mail hello@two.test or eva.klein@two.test"), ("none.test", 0, "nothing"), ("o.test", 1, "x@o.test"), ("far.test", 0, "a.b@far.test")]
    pages = spark.createDataFrame(pages, "site string, page_ord int, html string")
    founders = spark.createDataFrame([("IT Two", "Mia Stone", "Founder"), ("IT Two", "Bo Field", "Manager"), ("IT One", "No One", "CEO")], "company_name string, person string, title string")
    rows = {r.company_name: r for r in run_all_locations(cities, outputs, elements, [hits], [False], pages, founders).collect()}
    assert set(rows) == {"IT One", "IT Two", "Other"} and {r.location for r in rows.values()} == {"A"}
    one, two, other = rows["IT One"], rows["IT Two"], rows["Other"]
    assert (one.contact_person, one.founder_source, one.source, one.contact_email) == ("Ann Lee", "website", "OSM", "info@one.test")
    assert (two.contact_person, two.contact_title, two.founder_source, two.contact_email_inferred) == ("Mia Stone", "Founder", "search", "mia.stone@two.test")
    assert (other.source, other.founder_source, other.all_emails_found) == ("HERE", "none", "x@o.test")


def test_each_address_is_judged_once(spark):
    rows = [(1, "a@b.test", "A@b.test; no"), (2, "", "no"), (3, None, "c@d.test, e@f.test"), (4, "", None), (1, "a@b.test", "A@b.test; no")]
    df = clean.clean_contacts(spark.createDataFrame(rows, "ord long, contact_email string, all_emails_found string"))
    assert sorted(map(tuple, df.collect())) == [(1, "a@b.test", "a@b.test")] * 2 + [(3, "c@d.test", "c@d.test; e@f.test")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"@.*\d+\.\d+\.\d+") == 1
