"""Contact tables derived by plain SQL from the supplied tables.

The same text runs on Spark, where {name} stands for a DataFrame, and as the
first part of a check's SQL, where it stands for the table of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTACTS = """
select c_custkey as ord, concat(n_name, ' ', cast(cast(floor(c_custkey / 200) as bigint) as string)) as location, c_mktsegment as niche,
  concat(case when c_custkey % 3 = 0 then 'ACME ' else 'Acme ' end, cast(cast(floor(c_custkey / 7) as bigint) as string)) as company_name,
  concat(case when c_custkey % 4 = 0 then 'https://www.CO' else 'https://www.co' end, cast(cast(floor(c_custkey / 7) as bigint) as string), '.test') as website,
  case c_custkey % 4 when 0 then 'OSM' when 1 then 'OSM (fill)' when 2 then 'HERE' else 'DuckDuckGo' end as source,
  case when c_custkey % 2 = 0 then concat('+1415555', cast(1000 + c_custkey % 9000 as string)) else '' end as phone_number,
  case when c_custkey % 3 = 1 then concat('Ann Lee', case when c_custkey % 2 = 0 then 'son' else '' end) else '' end as contact_person,
  case when c_custkey % 3 = 1 then 'CEO' else '' end as contact_title,
  case c_custkey % 7 when 0 then '' when 1 then concat('Info@co', cast(cast(floor(c_custkey / 7) as bigint) as string), '.test') when 2 then '0123456789abcdef0123456789abcdef@sentry.test'
    when 3 then concat('20background@co', cast(cast(floor(c_custkey / 7) as bigint) as string), '.test') when 4 then concat('ann.lee', cast(c_custkey as string), '@gmail.com') when 5 then 'me@mydomain.com'
    else concat('a@co', cast(cast(floor(c_custkey / 7) as bigint) as string), '.test') end as contact_email,
  concat(case when c_custkey % 2 = 0 then concat('info@co', cast(cast(floor(c_custkey / 7) as bigint) as string), '.test; ') else '' end,
    case when c_custkey % 3 = 0 then concat('ann.lee@co', cast(cast(floor(c_custkey / 7) as bigint) as string), '.test, ANN.LEE@co', cast(cast(floor(c_custkey / 7) as bigint) as string), '.test;') else '' end,
    case when c_custkey % 5 = 0 then 'noreply@junk.test; logo@2x.1.2.3' when c_custkey % 5 = 1 then concat(' Jobs@www.co', cast(cast(floor(c_custkey / 7) as bigint) as string), '.test ') else concat('deadbe@co', cast(cast(floor(c_custkey / 7) as bigint) as string), '.test') end) as all_emails_found
from {customer} join {nation} on c_nationkey = n_nationkey
"""

DNS = """
select domain, rtype, status, type, data from (
  select concat('co', cast(s_suppkey as string), '.test') as domain, case when s_suppkey % 7 < 5 then 15 else 16 end as rtype,
    case when s_suppkey % 11 = 0 then 2 when s_suppkey % 7 = 0 then 3 else 0 end as status,
    case when s_suppkey % 11 = 0 or s_suppkey % 7 = 0 then null when s_suppkey % 13 = 0 then 5 else 15 end as type,
    case when s_suppkey % 11 = 0 or s_suppkey % 7 = 0 then null when s_suppkey % 17 = 0 then '0 .' else concat(cast(10 * (1 + s_suppkey % 3) as string), ' mx', cast(s_suppkey % 5 as string), '.co.test.') end as data
  from {supplier}
  union all
  select concat('co', cast(s_suppkey as string), '.test'), 1, case when s_suppkey % 5 = 0 then 3 when s_suppkey % 5 = 1 then 2 else 0 end, case when s_suppkey % 5 < 2 then null else 1 end, case when s_suppkey % 5 < 2 then null else '192.0.2.1' end
  from {supplier}
  union all
  select concat('co', cast(s_suppkey as string), '.test'), 28, case when s_suppkey % 3 = 0 then 0 else 3 end, case when s_suppkey % 3 = 0 then 28 else null end, case when s_suppkey % 3 = 0 then '2001:db8::1' else null end
  from {supplier}
  union all
  select 'gmail.com', 15, 0, 15, '5 gmail-smtp-in.l.google.com.' from {region} where r_regionkey = 0
) t
"""

MAILBOX = """
select concat('info@co', cast(s_suppkey as string), '.test') as email, case when s_suppkey % 3 > 0 then s_suppkey % 2 = 0 end as accepted from {supplier}
"""

LOG = """
select distinct concat(case when o_custkey % 2 = 0 then 'INFO@co' else 'info@co' end, cast(cast(floor(o_custkey / 7) as bigint) as string), '.test') as recipient_email
from {orders} where o_totalprice > 400000
"""

ELEMENTS = """
select case when p_partkey % 3 = 0 then 'way' else 'node' end as type, cast(floor(p_partkey / 2) as bigint) as id, p_partkey as ord,
  cast(p_partkey % 90 as double) as lat, cast(p_partkey % 180 as double) as lon,
  case p_partkey % 4 when 0 then 'it' when 1 then 'bakery' when 2 then 'data, cloud' else 'fitness gym' end as niche,
  case p_partkey % 6 when 0 then concat('IT ', p_name) when 1 then concat('Data ', p_name, ' Systems') when 2 then concat(p_name, ' Bakery') when 3 then '' when 4 then concat('Techno', p_name) else p_name end as name,
  case p_partkey % 5 when 0 then 'it' when 1 then 'company' else '' end as office,
  case when p_partkey % 7 = 0 then 'bakery' else '' end as shop,
  case when p_partkey % 8 = 0 then 'Cloud software' else '' end as industry,
  case p_partkey % 9 when 0 then '' when 1 then 'https://www.facebook.com/x' when 2 then 'fedex.com' else concat('https://p', cast(cast(floor(p_partkey / 8) as bigint) as string), '.test/') end as website,
  concat('city', cast(cast(floor(p_partkey / 80) as bigint) as string)) as location
from {part}
"""

#: Elements by their place alone, some without one.
POINTS = """
select case when p_partkey % 3 = 0 then 'way' else 'node' end as type, p_partkey as id, p_partkey as ord,
  case when p_partkey % 50 = 0 then null else cast(p_partkey * 37 % 3000 as double) / 100 - 2 end as lat, cast(p_partkey * 53 % 5600 as double) / 100 - 3 as lon
from {part}
"""

#: Companies of other sources, in the niches and locations of the elements.
HITS = {
    "HERE": """select concat('h', cast(p_partkey as string)) as id, case p_partkey % 3 when 0 then p_name when 1 then concat(p_name, ' Ltd') else concat(p_brand, ' ', cast(p_size as string)) end as name,
  concat('https://h', cast(cast(floor(p_partkey / 3) as bigint) as string), '.test') as website, 'HERE' as source,
  case p_partkey % 4 when 1 then 'it' when 2 then 'bakery' when 3 then 'data, cloud' else 'fitness gym' end as niche, concat('city', cast(cast(floor(p_partkey / 80) as bigint) as string)) as location from {part}""",
    "Google": """select concat('i', cast(p_partkey as string)) as id, concat(p_type, case when p_partkey % 2 = 0 then ' Works' else '' end) as name,
  concat('https://', case when p_partkey % 5 = 0 then 'p' else 'g' end, cast(cast(floor(p_partkey / 8) as bigint) as string), '.test') as website, 'Google' as source,
  case p_partkey % 4 when 0 then 'it' when 1 then 'bakery' when 2 then 'data, cloud' else 'fitness gym' end as niche, concat('city', cast(cast(floor(p_partkey / 80) as bigint) as string)) as location from {part}""",
}

CITIES = "select c_custkey as ord, concat('City ', cast(c_custkey as string)) as city from {customer}"
OUTPUTS = "select distinct concat('City ', cast(o_custkey as string)) as location from {orders} where o_totalprice > 400000"
#: The locations of the contacts.
NATION_CITIES = "select min(c_custkey) as ord, city from (select c_custkey, concat(n_name, ' ', cast(cast(floor(c_custkey / 200) as bigint) as string)) as city from {customer} join {nation} on c_nationkey = n_nationkey) t group by city"
NATION_OUTPUTS = "select distinct concat(n_name, ' ', cast(cast(floor(s_suppkey / 200) as bigint) as string)) as location from {supplier} join {nation} on s_nationkey = n_nationkey where s_acctbal < -900"

GAZETTEER = """
select concat('Place ', cast(c_custkey as string)) as name, concat('Place ', cast(c_custkey as string), ' Hotel, ', n_name, ', ', r_name) as display_name, case when c_custkey % 4 = 0 then 'hotel' else 'city' end as osm_type,
  cast(n_nationkey as double) as south, cast(n_nationkey as double) + case when c_custkey % 3 = 0 then 0.01 else 1.0 end as north,
  cast(n_nationkey as double) as west, cast(n_nationkey as double) + case when c_custkey % 3 = 0 then 0.01 else 1.0 end as east
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
union all
select concat(n_name, ', ', r_name), concat(n_name, ', ', r_name), case when n_nationkey % 2 = 0 then 'hotel' else 'state' end, 1.0, 5.0, cast(n_nationkey as double), cast(n_nationkey as double) + 4.0 from {nation} join {region} on n_regionkey = r_regionkey
union all
select r_name, concat(r_name, ', World'), 'region', -10.0, 10.0, cast(r_regionkey as double), cast(r_regionkey as double) + 30.0 from {region}
"""

NAMES = {
    "a": "select concat('a', cast(s_suppkey as string)) as id, concat('Firm ', cast(s_suppkey as string), ' Ltd') as name, concat('https://www.f', cast(s_suppkey as string), '.test') as website, 'OSM' as source from {supplier}",
    "b": "select concat('b', cast(c_custkey as string)) as id, concat('Shop ', cast(c_custkey as string), case when c_custkey % 5 = 0 then concat(' firm ', cast(cast(floor(c_custkey / 15) as bigint) as string), ' ltd') else '' end) as name, concat('https://b', cast(c_custkey as string), '.test') as website, 'HERE' as source from {customer}",
    "c": "select concat('c', cast(p_partkey as string)) as id, case when p_partkey % 2 = 0 then p_name else concat(p_name, ' ', cast(p_partkey as string)) end as name, concat('https://', case when p_partkey % 3 = 0 then 'f' else 'w' end, cast(cast(floor(p_partkey / 3) as bigint) as string), '.test') as website, 'Google' as source from {part}",
}

#: Pages of sites: a home, a page at a usual path, one that the home links, and one that nothing leads to.
STORE = """
select page_id, concat('s', k, '.test') as site,
  case page_id % 4 when 0 then concat('https://S', k, '.test/') when 1 then concat('http://s', k, '.test/contact/') when 2 then concat('https://s', k, '.test/who/people-', k, '#top') else concat('https://s', k, '.test/private') end as url,
  concat(case when page_id % 4 = 0 then concat('<a href="/who/people-', k, '">Our <b>Team</b></a><a href="https://else.test/team">Team</a>') else '' end, html,
    case page_id % 7 when 0 then '<p>Ann Lee, CEO of the firm</p>' when 1 then '<p>Managing Director John Doe</p>' when 2 then '<h3>Eva Klein</h3><p>Head of Sales</p>' when 3 then '<p>Bo Field, Manager</p>' else '<p>Our Team, founder</p>' end,
    case when page_id % 5 = 0 then '' else concat('<a href="mailto:x">info [at] s', k, ' [dot] test</a> p', cast(page_id as string), '.klein@s', k, '.test') end,
    case page_id % 3 when 0 then '' when 1 then ' +49 (0)30 1234567' else ' +1 415 555 0100' end) as html
from (select page_id, html, cast(cast(floor(page_id / 4) as bigint) as string) as k from {pages}) t
"""

#: Saved result pages that name a company and people near it, or none.
MENTIONS = """
select page_id, concat('<p>', case page_id % 4 when 0 then concat('News: firm ', k, ' LTD (founder Mia Stone, Founder) grows.') when 1 then concat('Bo Field, CEO of Firm ', k, ' Ltd, and Ann Lee, Manager')
  when 2 then concat('XFirm ', k, ' Ltd, John Doe, CEO') else concat('Firm ', k, ' Ltd opens. ', 'Nobody is named.') end, '</p>', html) as html
from (select page_id, html, cast(cast(floor(page_id / 3) as bigint) as string) as k from {pages}) t
"""
NAME_MENTIONS = """
select page_id, concat('<p>', case page_id % 3 when 0 then concat('Mia Stone, Founder of Data ', p_name, ' Systems') when 1 then concat('it ', p_name, ': Bo Field, CEO') else concat(p_name, ' BAKERY. Ann Lee, Manager') end, '</p>', html) as html
from {pages} join {part} on page_id = p_partkey
"""
FIRMS = "select concat('Firm ', cast(s_suppkey as string), ' Ltd') as company_name from {supplier}"

#: The stored pages of the elements' own sites.
ELEMENT_STORE = STORE.replace("concat('s', k", "concat('p', k").replace("//S'", "//P'").replace("//s'", "//p'").replace("[at] s'", "[at] p'").replace(".klein@s'", ".klein@p'")
#: Elements of other sources, by the places of the gazetteer.
PLACE_HITS = {k: text.replace("concat('city'", "concat('Place '") for k, text in HITS.items()}

#: Two searches' result pages, by niche and location.
RESULT_PAGES = """
select case page_id % 2 when 0 then 'it' else 'bakery' end as query, concat('city', cast(cast(floor(page_id / 8) as bigint) as string)) as location, page_id,
  concat('<h3><a href="https://a', cast(page_id as string), '.test/x">A &amp; B ', cast(page_id as string), '</a></h3>', case when page_id % 8 < 4 then concat('<h3><a href="https://more', cast(page_id as string), '.test">More</a></h3>') else '' end, html) as html
from {pages}
"""
SECOND_PAGES = """
select case page_id % 2 when 0 then 'it' else 'bakery' end as query, concat('city', cast(cast(floor(page_id / 8) as bigint) as string)) as location, page_id,
  concat('<a class="result__a" href="//r.test/?uddg=https%3A%2F%2Fother', cast(page_id as string), '.test%2Fp">Other ', cast(page_id as string), '</a>', html) as html
from {pages}
"""

_TABLES = ("customer", "nation", "region", "supplier", "part", "orders", "pages", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_spark(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in _TABLES if "{" + n + "}" in text})


def as_sql(text: str) -> str:
    """The text over the tables' names."""
    for n in _TABLES:
        text = text.replace("{" + n + "}", n)
    return text
