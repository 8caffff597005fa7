"""Unit tables of the column functions."""

import pytest
from pyspark.sql import functions as F

from cardfile.functions import scalars as S
from cardfile.operators import clean


def values(spark, rows, make):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", "a", "b"][: 1 + len(rows[0])])
    return [r[0] for r in df.select(make(*df.columns[1:]).alias("v"), "i").orderBy("i").select("v").collect()]


def test_target_emails(spark):
    table = {
        "info@acme.test": (True, True), "a@acme.test": (True, False), "deadbe@acme.test": (True, False), "deadbeef@acme.test": (False, False), "20background@acme.test": (True, False),
        "x@a.io": (True, False), "me@bundle.3.2.1": (False, False), "é@acme.test": (False, False), "me@mydomain.com": (False, False), "me@counterexample.org": (True, True),
        "me@example.org": (False, False), "plain": (False, False), "": (False, False), "hello@www.old.test": (False, False),
    }
    rows = [(k,) for k in table]
    assert values(spark, rows, S.is_valid_target_email) == [v[0] for v in table.values()]
    assert values(spark, rows, lambda c: S.is_valid_target_email(c, True)) == [v[1] for v in table.values()]


def test_phones(spark):
    table = {"+49 (0)30 1234567": "+490301234567", "0049 30 123456": "+4930123456", "+12520260925": "+12520260925", "030-123456": "030123456", "555 1234": None}
    assert values(spark, [(k,) for k in table], S.normalize_phone) == list(table.values())
    valid = {"+490301234567": True, "+4930123456": False, "+12520260925": True, "+1252026092525": False, "030123456": False, "": False, "+999": False}
    assert values(spark, [(k,) for k in valid], S.is_valid_phone) == list(valid.values())


def test_titles(spark):
    table = {"CEO": 10, "Co-Founder": 20, "Managing Director": 30, "Vice President": 40, "Director": 60, "Team Member": 999, "PRÉSIDENTE": 10}
    assert values(spark, [(k,) for k in table], S.title_rank) == list(table.values())


def test_people(spark):
    html = "<p>Ann Lee, CEO</p><p>Our Team, founder</p><h3>Eva Klein</h3><p>Head of Sales</p>"
    found = values(spark, [(html,)], S.extract_people)[0]
    assert [(p["score"], p["name"]) for p in found] == [(10, "Ann Lee"), (80, "Eva Klein")]


def test_deobfuscated_emails(spark):
    table = {"info [at] acme [dot] test": ["info@acme.test"], "info&#64;acme&#46;test": ["info@acme.test"], "INFO(AT)acme(dot)test": ["info@acme.test"], "logo@2x.png a@b.test": ["a@b.test"], "none": [], None: None}
    assert values(spark, [(k,) for k in table], S.extract_emails) == list(table.values())


def test_urls(spark):
    table = {" //a.test/ ": "https://a.test", "a.test": "https://a.test", "http://a.test//": "http://a.test", "": ""}
    assert values(spark, [(k,) for k in table], S.normalize_url) == list(table.values())
    assert values(spark, [("https://www.A.test:80/x",), ("a.test",), (None,)], S.url_domain) == ["a.test:80", "", ""]
    joined = {"/x": "https://a.test/x", "y": "https://a.test/d/y", "../z": "https://a.test/z", "//b.test/q": "https://b.test/q", "https://c.test": "https://c.test"}
    assert values(spark, [("https://a.test/d/e", k) for k in joined], S.url_join) == list(joined.values())


def test_directory_hosts(spark):
    rows = [("x.com",), ("fedex.com",), ("m.x.com",)]
    assert values(spark, rows, lambda c: S.is_directory_host(F.col(c), ("x.com",))) == [True, False, True]
    assert values(spark, rows, lambda c: S.is_directory_host(F.col(c), ("x.com",), "substring")) == [True, True, True]


def test_first_spelling_wins(spark):
    assert values(spark, [("a@m.test", "A@m.test; b@m.test, a@m.test;;")], clean.collect_row_emails) == [["a@m.test", "b@m.test"]]


@pytest.mark.parametrize(("name", "pattern", "want"), [("Ann Lee", "{first}.{last}", "ann.lee@a.test"), ("Ann Lee", "{f}{last}", "alee@a.test"), ("Ann", "{first}", "ann@a.test"), (" ", "{first}", "")])
def test_guessed_addresses(spark, name, pattern, want):
    assert values(spark, [(name, pattern)], lambda n, p: S.address_from_pattern(n, F.lit("a.test"), p)) == [want]


def test_keywords_slugs_templates_mx(spark):
    assert values(spark, [("Real Estate, IT & a",)], S.niche_keywords) == [["real estate", "real", "estate", "it", "a"]]
    assert values(spark, [("Austin, Texas",)], S.slug) == ["Austin__Texas"]
    assert values(spark, [("Hi {n}, {gone}!",)], lambda c: S.render_template(c, {"n": F.lit("Ann"), "gone": F.lit(None)})) == ["Hi Ann, !"]
    assert values(spark, [("10 b.mx.test.",), ("0 .",), ("x",), (None,)], S.parse_mx) == [(10, "b.mx.test"), None, None, None]
