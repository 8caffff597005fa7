"""The registered queries as DuckDB SQL, written from their meaning and not from their plans."""

from __future__ import annotations

import re

from cardfile.functions import constants as C
from cardfile.plans import derived as D


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_JUNK = "|".join(C.JUNK_PATTERNS)


def _domain(e: str) -> str:
    return f"lower(substr({e}, strpos({e}, '@') + 1))"


def _target(e: str, strict: bool = False, junk: bool = True) -> str:
    """Whether the address expression e is worth keeping."""
    e = f"lower(trim({e}))"
    local, domain = f"split_part({e}, '@', 1)", _domain(e)
    rules = [f"strpos({e}, '@') > 0", f"contains(split_part({e}, '@', 2), '.')", rf"not regexp_matches({e}, '@.*\d+\.\d+\.\d+')", f"not contains({domain}, '.www.')", f"not starts_with({domain}, 'www.')", rf"not regexp_matches({e}, '[^\x00-\x7F]')"]
    if junk:
        rules.append(f"not regexp_matches({e}, '{_JUNK}')")
    if strict:
        rules += [f"length({local}) >= 2", f"not regexp_matches({local}, '^[a-f0-9]{{6,}}$')", rf"not regexp_matches({local}, '^\d+[a-z]')", f"length({domain}) >= 6"]
    return "(" + " and ".join(rules) + ")"


def _spam(e: str) -> str:
    domain = f"lower(split_part({e}, '@', 2))"
    return rf"(regexp_matches(lower({e}), '\.({'|'.join(C.IMAGE_SUFFIXES)})$') or regexp_matches({domain}, '^\d+\.\d+\.\d+\.\d+$') or {domain} in ({_list(C.PLACEHOLDER_DOMAINS)}) or regexp_matches({domain}, '\b(tracking|analytics|marketing|newsletter|mailchimp)\b') or length(split_part({e}, '@', 1)) > 40)"


def _preferred(e: str) -> str:
    return f"regexp_matches(lower({e}), '^({'|'.join(C.PREFERRED_PREFIXES)})')"


def _cells(cell: str, separators: str = "[;,]") -> str:
    return f"list_filter(list_transform(regexp_split_to_array({cell}, '{separators}'), lambda x: trim(x)), lambda x: x <> '')"


_CONTACTS = "contacts as (" + D.as_sql(D.CONTACTS) + ")"
_EMAILS = r"""
texts as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s*(\[at\]|\(at\))\s*', '@', 'gi'), '\s*(\[dot\]|\(dot\))\s*', '.', 'gi'), '\s+@\s+', '@', 'g'), '\s+\.\s+', '.', 'g') as text from documents),
found as (select doc_id, list_filter(regexp_extract_all(text, '""" + C.EMAIL + "'), lambda e: not " + _spam("e") + """) as emails from texts where contains(text, '@')),
doc_emails as (select doc_id, unnest(range(len(emails))) as pos, lower(unnest(emails)) as email from found)
"""
#: Rows (ord, pos, email) of a contact's addresses in order, distinct by lower case, the first spelling kept.
_ROW_EMAILS = f"""
cells as (select ord, contact_email, company_name, location, niche, {_cells("contact_email")} || {_cells("all_emails_found")} as emails from contacts),
spread as (select ord, contact_email, company_name, location, niche, unnest(range(len(emails))) as pos, unnest(emails) as email from cells),
row_emails as (select * from spread qualify row_number() over (partition by ord, lower(email) order by pos) = 1)
"""


def _clean(strict: bool) -> str:
    ok = _target("email", strict)
    return f"""with {_CONTACTS}, {_ROW_EMAILS}, kept as (select * from row_emails where {ok})
    select ord, any_value(company_name) as company_name, coalesce(first(email order by pos) filter (lower(email) = lower(contact_email)), first(email order by pos)) as contact_email,
      string_agg(email, '; ' order by pos) as all_emails_found from kept group by ord"""


def _picked(separators: str = "[;,]") -> str:
    return f"picked as (select *, case when {_target('contact_email')} then contact_email else coalesce(list_filter({_cells('all_emails_found', separators)}, lambda e: {_target('e')})[1], '') end as email from contacts)"



_MX = (
    "dns as (" + D.as_sql(D.DNS) + r"""),
mx_hosts as (select domain, rtype, status, type, case when rtype = 15 and type = 15 and regexp_replace(split_part(data, ' ', 2), '\.+$', '') <> '' then cast(split_part(data, ' ', 1) as int) end as pref, regexp_replace(split_part(data, ' ', 2), '\.+$', '') as host from dns),
domains as (select domain,
  case when count(pref) > 0 then true when bool_or(rtype = 15 and status in (0, 3)) then false end as has_mx,
  first(host order by pref, host) filter (pref is not null) as mx_host,
  case when bool_or(rtype in (1, 28) and rtype = type and status = 0) then true
       when count(*) filter (rtype = 1 and status in (0, 3)) > 0 and count(*) filter (rtype = 28 and status in (0, 3)) > 0 and count(*) filter (rtype in (1, 28) and status not in (0, 3)) = 0 then false end as has_addr
  from mx_hosts group by domain)"""
)
_VERIFIED = (
    f"{_CONTACTS}, {_picked()}, {_MX}, mailbox as (select lower(email) as email, bool_or(accepted) as accepted from ("
    + D.as_sql(D.MAILBOX)
    + f""") t group by 1),
asked as (select ord, p.email, d.*, m.accepted, {_domain("p.email")} as asked_domain from picked p left join domains d on d.domain = {_domain("p.email")} left join mailbox m on m.email = lower(p.email) where p.email <> ''),
said as (select ord, email, case
  when not {_target("email", True)} then 'invalid|fails format / junk checks'
  when has_mx is null then 'unknown|DNS lookup failed (network / resolver)'
  when not has_mx and has_addr then 'unknown|no MX record but domain resolves (A-record fallback)'
  when not has_mx and has_addr is null then 'unknown|no MX record; could not confirm A/AAAA record'
  when not has_mx then 'invalid|domain cannot receive mail (no MX, no A/AAAA record)'
  when asked_domain in ({_list(C.KNOWN_PROVIDERS)}) then 'valid|known provider with MX records'
  when accepted then concat('valid|mailbox accepted by ', mx_host)
  when not accepted then concat('invalid|mailbox rejected by ', mx_host, ' (550)')
  else concat('unknown|mail server ', mx_host, ' did not confirm (blocked / timeout)') end as said from asked)"""
)
_HOST = "regexp_replace(regexp_extract(lower({}), '^https?://([^/?#]+)', 1), '^www[.]', '')"
_NTH_CITY = "cities as (" + D.as_sql(D.CITIES) + "), numbered as (select ord, city, row_number() over (order by ord) - 1 as nth from cities)"


def _keyword_rules(name: str) -> tuple[str, str]:
    """Whether a name is relevant, and whether it is loosely, by the four niches of the derived elements."""
    keywords = {"it": ["it"], "bakery": ["bakery"], "data, cloud": ["data", "cloud"], "fitness gym": ["fitness gym", "fitness", "gym"]}
    strict, loose = [], []
    for niche, words in keywords.items():
        whole = [w for w in words if len(w) > 2] + list(C.NICHE_TERMS.get(niche, ()))
        rules = [rf"regexp_matches({name}, '^{w}([\s\-]|$)')" for w in words if len(w) <= 2] + ([rf"regexp_matches({name}, '\b({'|'.join(whole)})\b')"] if whole else [])
        strict.append(f"(niche = '{niche}' and ({' or '.join(rules)}))")
        within = [w for w in whole if len(w) >= 3]
        if within:
            loose.append(f"(niche = '{niche}' and regexp_matches({name}, '{'|'.join(within)}'))")
    return "(" + " or ".join(strict) + ")", "(" + " or ".join(loose) + ")"


_RELEVANT, _RELAXED = _keyword_rules("lower(name)")
_ELEMENTS = "elements as (" + D.as_sql(D.ELEMENTS) + ")"
_TAGGED = "((niche in ('it', 'data, cloud') and office = 'it') or (niche = 'bakery' and shop = 'bakery'))"
_KEYWORDS = "(case niche when 'it' then ['it'] when 'bakery' then ['bakery'] when 'data, cloud' then ['data', 'cloud'] else ['fitness gym', 'fitness', 'gym'] end)"


def _has(c: str) -> str:
    return f"len(list_filter({_KEYWORDS}, lambda k: contains(lower({c}), k))) > 0"


def _merge() -> str:
    """Sources a, b and c in turn; within a source an earlier id wins."""
    parts = []
    for k, priority in (("a", 0), ("b", 1), ("c", 2)):
        parts.append(f"src_{k} as (select id, name, lower(trim(name)) as key, website, source, {priority} as priority, {_HOST.format('website')} as host from ({D.as_sql(D.NAMES[k])}) t)")
    like = "(contains(x.key, y.key) or contains(y.key, x.key))"
    own = lambda t: f"select * from {t} x where not exists (select 1 from {t} y where y.id < x.id and {like})"
    parts.append(f"kept_a as ({own('src_a')})")
    parts.append(f"new_b as (select * from src_b x where not exists (select 1 from kept_a y where {like})), kept_b as ({own('new_b')})")
    parts.append("both_ab as (select * from kept_a union all select * from kept_b)")
    parts.append(f"new_c as (select * from src_c x where not exists (select 1 from both_ab y where {like} or (x.host <> '' and x.host = y.host)))")
    parts.append("hosts_c as (select * from new_c x where host = '' or not exists (select 1 from new_c y where y.host = x.host and y.id < x.id))")
    parts.append(f"kept_c as ({own('hosts_c')})")
    return "with " + ", ".join(parts) + " select id, name, source, priority from (select * from both_ab union all select * from kept_c) t"


def _merge_greedy() -> str:
    """One pass over sources a, b and c in the order of their ids: a name counts once a source, and a row is skipped if a kept one has its host (in c) or a like name."""
    parts = [f"src_{k} as (select id, name, lower(trim(name)) as key, source, {n} as priority, {_HOST.format('website')} as host from ({D.as_sql(D.NAMES[k])}) t qualify row_number() over (partition by lower(trim(name)) order by id) = 1)" for n, k in enumerate("abc")]
    return f"""with recursive {", ".join(parts)},
    every as materialized (select *, row_number() over (order by priority, id) as n from (select * from src_a union all select * from src_b union all select * from src_c) t),
    links as materialized (select x.n, list(y.n) as earlier from every x join every y on y.n < x.n and (contains(x.key, y.key) or contains(y.key, x.key) or (x.priority = 2 and x.host <> '' and x.host = y.host)) group by 1),
    pass as (select 0::bigint as n, []::bigint[] as kept union all
      select p.n + 1, case when list_has_any(coalesce(l.earlier, []), p.kept) then p.kept else list_append(p.kept, p.n + 1) end from pass p left join links l on l.n = p.n + 1 where p.n < (select max(n) from every)),
    ended as (select kept from pass order by n desc limit 1)
    select id, name, source, priority from every where n in (select unnest(kept) from ended)"""


_REGIONS = f"""with places as ({D.as_sql(D.GAZETTEER)}), judged as (select *, osm_type in ({_list(C.POI_TYPES)}) or (north - south < 0.02 and east - west < 0.02) as poi from places),
            tries as (select j.name as location, 0 as turn, concat(trim(split_part(display_name, ',', -2)), ', ', trim(split_part(display_name, ',', -1))) as candidate from judged j where poi and split_part(display_name, ',', 2) <> ''
              union all select name, 1, trim(split_part(display_name, ',', -1)) from judged where poi union all select name, 2, trim(split_part(name, ',', -1)) from judged where poi),
            wider as (select location, w.name, w.south, w.north, w.west, w.east from tries join judged w on w.name = candidate and not w.poi qualify row_number() over (partition by location order by turn, w.name) = 1)
            select j.name as location, coalesce(w.name, j.name) as region, coalesce(w.south, j.south) as south, coalesce(w.north, j.north) as north, coalesce(w.west, j.west) as west, coalesce(w.east, j.east) as east from judged j left join wider w on w.location = j.name"""


def _located() -> str:
    """Points within the resolved boxes, by comparing all with all."""
    return f"""with regions as ({_REGIONS}), points as ({D.as_sql(D.POINTS)})
    select p.type, p.id, p.ord, r.location from points p join regions r on p.lat between r.south and r.north and p.lon between r.west and r.east"""


def _niche_matches() -> str:
    """Every element with every niche of the tables."""
    quoted = lambda words: "[" + ", ".join("'" + w + "'" for w in words) + "]"
    rows = []
    for niche in C.NICHE_TAGS:
        phrases = [p.strip() for p in re.split("[,/&]+", niche.lower()) if p.strip()]
        keywords = list(dict.fromkeys(w for p in phrases for w in [p, *[x for x in p.split() if len(x) > 1]]))
        tags = [t for k in [niche, *keywords] for t in C.NICHE_TAGS.get(k, ()) if t != "office=company"]
        terms = list(C.NICHE_TERMS.get(niche, ()))
        whole = [k for k in keywords if len(k) > 2] + terms
        start = [k for k in keywords if len(k) <= 2]
        pattern = "|".join([*(rf"^{re.escape(k)}([\s\-]|$)" for k in start), *([rf"\b({'|'.join(map(re.escape, whole))})\b"] if whole else [])])
        rows.append(f"('{niche}', {quoted(tags)}, '{pattern}', {quoted([w for w in keywords + terms if len(w) >= 3])})")
    return f"""with {_ELEMENTS}, niches(niche, tags, pattern, loose) as (values {", ".join(rows)}),
    judged as (select e.ord, n.niche, list_contains(n.tags, 'office=' || lower(e.office)) or list_contains(n.tags, 'shop=' || lower(e.shop)) or (e.name <> '' and regexp_matches(lower(e.name), n.pattern)) as relevant,
      len(list_filter(n.loose, lambda w: contains(lower(e.name), w))) > 0 as relaxed from elements e, niches n)
    select ord, niche, relevant, relaxed from judged where relevant or relaxed"""


_FOUND = f"(((office <> '' or shop <> '') and {_has('name')}) or (office <> '' and {_has('industry')}) or {_has('office')} or {_has('shop')} or office = 'company' or {_TAGGED})"


def _candidates(target: int, relaxed_min: int, catch_all_min: int) -> str:
    same = "x.niche = y.niche and x.location = y.location"
    like = f"{same} and (contains(lower(trim(x.name)), lower(trim(y.name))) or contains(lower(trim(y.name)), lower(trim(x.name))))"
    source = lambda k: f"select id, name, website, source, niche, location, {_HOST.format('website')} as host from ({D.as_sql(D.HITS[k])}) t"
    own = lambda t: f"select * from {t} x where not exists (select 1 from {t} y where y.id < x.id and {like})"
    return f"""with {_ELEMENTS}, hit as (select * from elements where {_FOUND}),
    counted as (select niche, location, count(distinct (type, id)) as n from hit group by 1, 2),
    wide as (select e.* from elements e left join counted c on e.niche = c.niche and e.location = c.location where name <> '' and website <> '' and coalesce(n, 0) < {catch_all_min}),
    every as (select * from (select *, 1 as phase from hit union all select *, 2 from wide) t qualify row_number() over (partition by niche, location, type, id order by phase, ord) = 1),
    usable as (select ord, niche, location, trim(name) as name, regexp_replace(case when regexp_matches(website, '^https?://') then website else concat('https://', website) end, '/+$', '') as site,
      ({_TAGGED} or {_RELEVANT}) as relevant, {_RELAXED} as relaxed from every where trim(name) <> '' and website <> '' and website <> 'https://www.facebook.com/x'),
    judged as (select *, {_HOST.format('site')} as host, count(*) filter (relevant) over (partition by niche, location) as n from usable),
    chosen as (select * from judged where relevant or (relaxed and n < {relaxed_min})),
    fresh as (select * from judged j where not exists (select 1 from chosen c where c.niche = j.niche and c.location = j.location and (c.ord = j.ord or c.host = j.host)) qualify row_number() over (partition by niche, location, host order by ord) = 1),
    ranked as (select *, row_number() over (partition by niche, location order by ord) as nth from fresh),
    first as (select niche, location, concat('e', cast(ord as varchar)) as id, name, site as website, 'OSM' as source, host from chosen union all
      select niche, location, concat('e', cast(ord as varchar)), name, site, 'OSM (fill)', host from ranked r where nth <= {target} - (select count(*) from chosen c where c.niche = r.niche and c.location = r.location)),
    src_h as ({source("HERE")}), new_h as (select * from src_h x where not exists (select 1 from first y where {like})), kept_h as ({own("new_h")}),
    both_h as (select niche, location, id, name, website, source, host from first union all select niche, location, id, name, website, source, host from kept_h),
    src_g as ({source("Google")}), new_g as (select * from src_g x where not exists (select 1 from both_h y where {like}) and not exists (select 1 from both_h y where {same} and x.host <> '' and x.host = y.host)),
    hosts_g as (select * from new_g x where host = '' or not exists (select 1 from new_g y where {same} and y.host = x.host and y.id < x.id)), kept_g as ({own("hosts_g")})
    select niche, location, id, name, website, source, case source when 'HERE' then 1 when 'Google' then 2 else 0 end as priority from (select * from both_h union all select niche, location, id, name, website, source, host from kept_g) t"""


def _links_of(saved: str) -> str:
    """CTEs up to links (query, location, pos, host, url, name) of saved, a CTE with query, location and html."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = lambda p, n: f"regexp_extract_all(html, {quoted(p)}, {n}, 'is')"
    return rf"""{saved},
    lists as (select query, location, {found(C.RESULT_HEADING, 1)} || {found(C.RESULT_LINK, 1)} as h, {found(C.RESULT_HEADING, 2)} || {found(C.RESULT_LINK, 2)} as t from saved),
    spread as (select query, location, unnest(range(len(h))) as pos, unnest(h) as href, unnest(t) as title from lists),
    named as (select query, location, pos, case when contains(href, 'uddg=') then url_decode(regexp_extract(href, 'uddg=([^&#]*)', 1)) else href end as url, trim(replace(regexp_replace(title, '<[^>]+>', '', 'g'), '&amp;', '&')) as name from spread),
    hosted as (select *, {_HOST.format('url')} as host from named),
    links as (select query, location, pos::int as pos, host, url, name from hosted where host <> '' and not regexp_matches(host, '(^|\.)({'|'.join(C.SEARCH_HOSTS).replace('.', '[.]')})$')
    qualify row_number() over (partition by query, location, host order by pos, url, name) = 1)"""


def _result_links() -> str:
    page = "concat('<h3><a href=\"', url, '\">A &amp; B ', cast(page_id as varchar), '</a></h3><h3><a href=\"https://www.yelp.com/x\">no</a></h3><a class=\"result__a\" href=\"//r.test/?uddg=https%3A%2F%2Fother', cast(page_id // 5 as varchar), '.test%2Fp\">Other</a>', html)"
    return f"with {_links_of(f'saved as (select {chr(39)}it{chr(39)} as query, cast(page_id // 10 as varchar) as location, {page} as html from pages)')} select * from links"


def _second_search(least: int) -> str:
    rows = lambda text, source, mark: f"(with {_links_of(f'saved as ({D.as_sql(text)})')} select query as niche, location, '{mark}|' || lpad(pos::varchar, 6, '0') || '|' || host as id, name, url as website, '{source}' as source from links)"
    return f"""with first as {rows(D.RESULT_PAGES, "Google", "g")}, second as {rows(D.SECOND_PAGES, "DuckDuckGo", "d")}
    select * from first union all select * from second s where (select count(*) from first f where f.niche = s.niche and f.location = s.location) < {least}"""


def _founders(mentions: str, firms: str, reach: int = 200) -> str:
    """The best person in the characters around each company's first mention in a page, all pages with all companies."""
    text = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
    return rf"""with firms as (select distinct lower(trim(company_name)) as company_name from ({D.as_sql(firms)}) t), told as (select distinct {text} as text from ({D.as_sql(mentions)}) t),
    lowered as materialized (select text, lower(text) as low from told), held as materialized (select company_name, text, low from lowered join firms on contains(low, company_name)),
    met as (select company_name, text, regexp_extract(low, '^(.*?(?:^|[^\pL\pN]))' || company_name || '($|[^\pL\pN])', 1) as x from held where regexp_matches(low, '(^|[^\pL\pN])' || company_name || '($|[^\pL\pN])')),
    placed as (select company_name, text, length(x) + 1 as place from met),
    bodies as (select company_name as site, row_number() over () as n, substr(text, greatest(place - {reach}, 1), place - greatest(place - {reach}, 1) + length(company_name) + {reach}) as html from placed),
    {_people("site, n")}
    select site as company_name, score::int as score, name as person, title from people qualify row_number() over (partition by site order by score, name, title) = 1"""


def _page_plan(most: int, hints=()) -> str:
    host = "lower(regexp_extract({}, '^https?://([^/?#]+)', 1))"
    paths = ", ".join(f"'{p}'" for p in C.CONTACT_PATHS)
    anchor, hinted = r"""'<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>'""", f"and regexp_matches(lower(href) || ' ' || lower(regexp_replace(said, '<[^>]+>', ' ', 'g')), '{'|'.join(hints)}')"
    return rf"""with links as (select page_id, url, unnest(range(len(h))) as pos, unnest(h) as href, unnest(t) as said from (select page_id, url, regexp_extract_all(html, {anchor}, 1, 'is') as h, regexp_extract_all(html, {anchor}, 2, 'is') as t from pages) t),
    kept as (select page_id, url, trim(href) as href, row_number() over (partition by page_id order by pos) - 1 as pos from links where trim(href) <> '' and not regexp_matches(trim(href), '^(#|mailto:|tel:|javascript:|data:)') {hinted if hints else ""}),
    whole as (select page_id, url as base, pos, regexp_replace(case when starts_with(href, 'http') then href else concat(regexp_extract(url, '^https?://[^/?#]+'), href) end, '/+$', '') as url from kept),
    every as (select page_id, regexp_replace(url, '/+$', '') as url, 0 as kind, 0 as pos from pages
      union all select page_id, url, 1, pos from whole where {host.format('url')} = {host.format('base')}
      union all select page_id, concat(regexp_replace(url, '/+$', ''), path), 2, nth from pages, (select unnest([{paths}]) as path, unnest(range({len(C.CONTACT_PATHS)})) as nth) p),
    once as (select * from every qualify row_number() over (partition by page_id, url order by kind, pos) = 1)
    select page_id, url, (row_number() over (partition by page_id order by kind, pos, url))::int as rank from once qualify rank <= {most}"""


_PEOPLE_PAGES = r"""bodies as (select page_id, concat('site', cast(page_id as varchar), '.test') as site, concat(html,
  case page_id % 4 when 0 then '<p>Ann Lee, CEO of the firm</p>' when 1 then '<p>Managing Director John Doe</p>' when 2 then '<h3>Eva Klein</h3><p>Head of Sales</p>' else '<p>Our Team, founder</p>' end,
  '<a href="mailto:x">info [at] site', cast(page_id as varchar), ' [dot] test</a> eva.klein@site', cast(page_id as varchar), '.test +49 (0)30 1234567') as html from pages)"""


def _people(key: str = "site") -> str:
    """CTEs up to people (key, score, name, title): names in the 60 characters before and after each title, and headings; the first of a name stays."""
    title = "(?:" + "|".join(p for _, p in C.TITLES) + ")"
    name = C.PERSON_NAME
    heading = "<h[2-6][^>]*>([^<]{2,50})</h[2-6]>[^<]*(?:<p[^>]*>[^<]{0,150}</p>|<div[^>]*>[^<]{0,150}</div>)"
    rank = "case " + " ".join(f"when regexp_matches(lower(trim(title)), '{p}') then {r}" for r, p in C.TITLES) + " else 999 end"
    text = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
    return rf"""texts as (select {key}, string_split(regexp_replace({text}, '({title})', chr(1) || '\1' || chr(2), 'gi'), chr(1)) as pieces from bodies),
    titled as (select {key}, unnest(range(len(pieces) - 1)) as k, pieces from texts),
    windows as (select {key}, k, split_part(pieces[k + 2], chr(2), 1) as title, right(replace(array_to_string(pieces[1:k + 1], ''), chr(2), ''), 60) as before,
      left(split_part(pieces[k + 2], chr(2), 2) || replace(array_to_string(pieces[k + 3:], ''), chr(2), ''), 60) as after from titled),
    headings as (select {key}, regexp_extract_all(html, '{heading}', 1, 'is') as h, regexp_extract_all(html, '{heading}', 0, 'is') as w from bodies),
    heads as (select {key}, unnest(range(len(h))) as k, unnest(h) as h, unnest(w) as w from headings),
    named as (select {key}, 0 as kind, k, regexp_extract_all(before, '{name}')[-1] as name, title from windows union all select {key}, 1, k, regexp_extract(after, '{name}'), title from windows
      union all select {key}, 2, k, regexp_extract(trim(h), '^{name}'), coalesce(nullif(regexp_extract(substr(w, length(h) + 5), '{title}', 0, 'i'), ''), 'Team Member') from heads),
    persons as (select *, string_split(regexp_replace(lower(name), '\s+', ' ', 'g'), ' ') as words from named where coalesce(name, '') <> '' and lower(name) not in ({_list(C.NON_NAMES)})),
    people as (select {key}, {rank} as score, name, trim(title) as title from persons where len(words) <= 3 and not list_has_any(words, [{_list(C.NON_NAME_WORDS)}]) qualify row_number() over (partition by {key}, lower(name) order by kind, k) = 1)"""


def _harvest(bodies: str = _PEOPLE_PAGES, key: str = "site") -> str:
    """bodies: a CTE with the columns of key, among them site, and html; a site's first phone is by them."""
    phone = r"regexp_replace(p, '[\s\-/().,]', '', 'g')"
    codes = "(values " + ", ".join(f"('{k}', {v})" for k, v in C.COUNTRY_DIGITS.items()) + ")"
    local = "split_part(email, '@', 1)"
    return rf"""with {bodies}, {_people(key)},
    plain as (select site, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\s*(\[at\]|\(at\))\s*', '@', 'gi'), '\s*(\[dot\]|\(dot\))\s*', '.', 'gi'), '\s+@\s+', '@', 'g'), '\s+\.\s+', '.', 'g') as text from bodies),
    raw_mails as (select distinct site, lower(unnest(regexp_extract_all(text, '{C.EMAIL}'))) as email from plain),
    mails as (select site, email, row_number() over (partition by site order by not {_preferred('email')}, email) as nth from raw_mails where not {_spam('email')} and {_target('email')}),
    said as (select *, case when not lower({local}) in ({_list(C.GENERIC_LOCALS)}) then case when regexp_matches({local}, '^\pL+\.\pL+$') then '{{first}}.{{last}}' when regexp_matches({local}, '^\pL+$') and length({local}) > 2 then '{{first}}' when regexp_matches({local}, '^\pL+_\pL+$') then '{{first}}_{{last}}' end end as pattern from mails where {_domain('email')} = site),
    patterns as (select site, coalesce(first(pattern order by nth) filter (pattern is not null), '{{first}}.{{last}}') as pattern from said group by 1),
    lists as (select site, string_agg(email, '; ' order by nth) as emails, coalesce(first(email order by nth) filter (lower({local}) not in ({_list(C.GENERIC_LOCALS)})), first(email order by nth)) as contact_email from mails group by 1),
    numbers as (select {key}, unnest(range(len(n))) as pos, unnest(n) as p from (select {key}, regexp_extract_all(html, '{C.PHONE}') as n from bodies) t),
    norm as (select {key}, pos, case when starts_with({phone}, '+') then {phone} when starts_with({phone}, '00') then concat('+', substr({phone}, 3)) when starts_with({phone}, '0') then {phone} end as phone from numbers),
    longest as (select phone, digits, code, least from (select distinct phone, regexp_replace(phone, '\D', '', 'g') as digits from norm where starts_with(phone, '+')) n join (select * from {codes} v(code, least)) c on starts_with(digits, code) qualify row_number() over (partition by phone order by length(code) desc) = 1),
    valid as (select phone from longest where length(digits) between 8 and 16 and case when code = '1' then length(digits) - 1 = least else length(digits) - length(code) between least and least + 1 end),
    phones as (select site, first(phone order by {key}, pos) as phone from norm where phone is not null and (not starts_with(phone, '+') or phone in (select phone from valid)) group by 1),
    best as (select * from people qualify row_number() over (partition by site order by score, name, title) = 1)
    select b.site, coalesce(l.emails, '') as emails, coalesce(phone, '') as phone_number, coalesce(name, '') as contact_person, coalesce(title, '') as contact_title, coalesce(contact_email, '') as contact_email,
      case when name is not null then replace(replace(pattern, '{{first}}', lower(split_part(name, ' ', 1))), '{{last}}', lower(split_part(name, ' ', -1))) || '@' || b.site end as contact_email_inferred,
      case when name is null then 'none' else 'website' end as founder_source
    from (select distinct site from bodies) b left join lists l using (site) left join phones using (site) left join best using (site) left join patterns using (site)"""


_PAGE_KEY = "lower(regexp_extract({0}, '^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract({0}, '^https?://[^/?#]+([^#]*)', 1), '/+$', '')"


def _planned(store: str = D.STORE) -> str:
    """The stored pages of each site's plan, from its home's links."""
    plan = _page_plan(16, C.CONTACT_HINTS).replace("from pages", "from homes").replace("with links", "links", 1)
    head, last = plan.rsplit("\n    select page_id", 1)
    return f"""store as ({D.as_sql(store)}), homes as (select site as page_id, concat('https://', site, '/') as url, html from store where page_id % 4 = 0), {head},
    planned as (select page_id{last}),
    keyed as (select page_id as site, {_PAGE_KEY.format('url')} as key, min(rank) as rank from planned group by 1, 2),
    bodies as (select k.site, k.rank - 1 as page_ord, s.html from keyed k join store s on {_PAGE_KEY.format('s.url')} = k.key)"""


def _contact_rows(candidates: str, sites: str, founders: str, due: str) -> str:
    """Contact rows of candidates in the locations for which `due` holds; founders: name, person and title."""
    searched = "h.contact_person = '' and f.person is not null"
    return f"""with founders as ({founders}),
    found as (select c.niche, c.location, c.id, c.priority, c.name as company_name, c.website, c.source, h.phone_number, case when {searched} then f.person else h.contact_person end as contact_person,
      case when {searched} then f.title else h.contact_title end as contact_title, h.contact_email, case when {searched} then 'search' else h.founder_source end as founder_source, h.emails as all_emails_found,
      case when {searched} then lower(replace(f.person, ' ', '.')) || '@' || h.site else h.contact_email_inferred end as contact_email_inferred
      from ({candidates}) c join ({sites}) h on h.site = {_HOST.format('c.website')} left join founders f on f.name = lower(trim(c.name)) where h.emails <> '' and {due}),
    once as (select * from found qualify row_number() over (partition by niche, location, lower(trim(company_name)), lower(trim(website)) order by priority, id) = 1)
    select niche, location, company_name, website, source, phone_number, contact_person, contact_title, contact_email, founder_source, all_emails_found, contact_email_inferred from once
    qualify row_number() over (partition by niche, location order by priority, id) <= 20"""


def _all_locations() -> str:
    sites = _harvest().replace("concat('site', cast(page_id as varchar), '.test') as site", "concat('p', cast(page_id as varchar), '.test') as site")
    founders = "select lower(trim(p_name)) as name, min(case when p_partkey % 2 = 0 then 'Mia Stone' else 'Mia Field' end) as person, 'Founder' as title from part group by 1"
    return _contact_rows(_candidates(12, 6, 8), sites, founders, "c.location not in (select concat('city', cast(s_suppkey * 7 + 3 as varchar)) from supplier)")


def _all_located() -> str:
    """As above, with elements by all points, boxes and niches, pages by plan, and founders by all pages and names."""
    due = """(select city from (select concat('Place ', cast(c_custkey as varchar)) as city, row_number() over (order by c_custkey) - 1 as nth from customer) t
      where nth % 20 = 0 and city not in (select concat('Place ', cast(s_suppkey * 40 as varchar)) from supplier))"""
    placed = f"""elements as (with base as ({D.as_sql(D.ELEMENTS)}), regions as ({_REGIONS}), points as ({D.as_sql(D.POINTS)}),
      every as (select b.* exclude (niche, location, lat, lon), r.location, n.niche from base b join points p using (ord) join regions r on p.lat between r.south and r.north and p.lon between r.west and r.east,
        (values ('it'), ('bakery'), ('data, cloud'), ('fitness gym')) n(niche) where r.location in {due})
      select * from every where {_TAGGED} or {_RELEVANT} or {_RELAXED})"""
    candidates = _candidates(12, 6, 8).replace(_ELEMENTS, placed)
    for k, text in D.HITS.items():
        candidates = candidates.replace(D.as_sql(text), D.as_sql(D.PLACE_HITS[k]))
    names = f"select name as company_name from ({D.as_sql(D.ELEMENTS)}) e union all " + " union all ".join(f"select name from ({D.as_sql(text)}) t" for text in D.HITS.values())
    founders = f"select company_name as name, person, title from ({_founders(D.NAME_MENTIONS, names)}) t"
    return _contact_rows(candidates, "with " + _harvest(_planned(D.ELEMENT_STORE), "site, page_ord").removeprefix("with "), founders, f"c.location in {due}")


def all_sql() -> dict[str, str]:
    phone = r"regexp_replace(p, '[\s\-/().,]', '', 'g')"
    codes = "(values " + ", ".join(f"('{k}', {v})" for k, v in C.COUNTRY_DIGITS.items()) + ")"
    pattern = r"""case when lower(local) in ({generic}) then null when regexp_matches(local, '^\pL+\.\pL+$') then '{{first}}.{{last}}' when regexp_matches(local, '^\pL+$') and length(local) > 2 then '{{first}}' when regexp_matches(local, '^\pL+_\pL+$') then '{{first}}_{{last}}' end""".format(generic=_list(C.GENERIC_LOCALS))
    return {
        "email_domains": f"with {_EMAILS} select {_domain('email')} as domain, count(*) as n, count(distinct email) as n_distinct, count(*) filter ({_target('email', junk=False)}) as n_lax, count(*) filter ({_target('email')}) as n_not_junk from doc_emails group by 1",
        "extract_emails": f"with {_EMAILS} select doc_id, pos, email from doc_emails",
        "email_validity": f"""with {_CONTACTS}, {_EMAILS}, every as (select unnest({_cells('all_emails_found')}) as email from contacts union select unnest({_cells('contact_email')}) from contacts union select email from doc_emails)
            select email, {_domain('email')} as domain, {_target('email')} as lax, {_target('email', True)} as strict, {_preferred('email')} as preferred, {_spam('email')} as spam from every""",
        "extract_phones": rf"""with raw as (select doc_id, unnest(regexp_extract_all(text, '{C.PHONE}')) as p from documents),
            norm as (select doc_id, case when starts_with({phone}, '+') then {phone} when starts_with({phone}, '00') then concat('+', substr({phone}, 3)) when starts_with({phone}, '0') then {phone} end as phone from raw),
            codes as (select * from {codes} v(code, least)),
            longest as (select phone, digits, code, least from (select distinct phone, regexp_replace(phone, '\D', '', 'g') as digits from norm where starts_with(phone, '+')) n join codes on starts_with(digits, code) qualify row_number() over (partition by phone order by length(code) desc) = 1),
            valid as (select phone from longest where length(digits) between 8 and 16 and case when code = '1' then length(digits) - 1 = least else length(digits) - length(code) between least and least + 1 end)
            select distinct doc_id, phone, case when starts_with(phone, '+') then 'international' else 'national' end as phone_kind from norm where phone is not null and (not starts_with(phone, '+') or phone in (select phone from valid))""",
        "html_text": r"select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages",
        "page_links": r"""with links as (select page_id, url, unnest(regexp_extract_all(html, '<a[^>]+href=["'']([^"'']+)["''][^>]*>.*?</a>', 1, 'is')) as href from pages)
            select distinct page_id, case when starts_with(href, 'http') then href else concat(regexp_extract(url, '^https?://[^/?#]+'), href) end as link from links where href <> '' and not regexp_matches(href, '^(#|mailto:|tel:|javascript:|data:)')""",
        "url_normalise": rf"""with raw as (select page_id, case page_id % 4 when 0 then url when 1 then regexp_replace(url, '^https?:', '') when 2 then regexp_replace(url, '^https?://', '') else concat(url, '//') end as raw from pages),
            whole as (select page_id, raw, regexp_replace(case when starts_with(raw, '//') then concat('https:', raw) when regexp_matches(raw, '^https?://') then raw else concat('https://', raw) end, '/+$', '') as url from raw)
            select page_id, url, {_HOST.format('url')} as domain, case when starts_with(raw, 'http') then raw else concat('https://', raw) end as with_scheme from whole""",
        "rank_emails": f"""with {_CONTACTS}, lists as (select ord, contact_email, {_cells('all_emails_found')} as emails from contacts),
            spread as (select ord, unnest(emails) as email, unnest(range(len(emails))) as pos from lists),
            ranks as (select ord, string_agg(email, '; ' order by not {_preferred('email')}, email) as ranked, coalesce(first(email order by pos) filter (lower(split_part(email, '@', 1)) not in ({_list(C.GENERIC_LOCALS)})), first(email order by pos)) as personal from spread group by ord)
            select l.ord, coalesce(ranked, '') as ranked, personal, case when {_target('contact_email')} then contact_email else coalesce(list_filter(emails, lambda e: {_target('e')})[1], '') end as best from lists l left join ranks r on l.ord = r.ord""",
        "collect_row_emails": f"with {_CONTACTS}, {_ROW_EMAILS} select c.ord, coalesce(string_agg(email, '; ' order by pos), '') as emails from contacts c left join row_emails r on c.ord = r.ord group by c.ord",
        "clean_contacts": _clean(False),
        "clean_contacts_strict": _clean(True),
        "clean_summary": f"""with {_CONTACTS}, {_ROW_EMAILS}, sums as (select c.ord, c.location, count(email) filter ({_target('email')}) as kept, count(email) filter (not {_target('email')}) as removed from contacts c left join row_emails r on c.ord = r.ord group by 1, 2)
            select coalesce(location, 'total') as location, count(*) filter (kept > 0) as rows_kept, count(*) filter (kept = 0) as rows_dropped, coalesce(sum(removed) filter (kept > 0), 0)::bigint as removed_from_kept, sum(removed)::bigint as removed from sums group by rollup (location)""",
        "removed_emails": f"with {_CONTACTS}, {_ROW_EMAILS} select company_name, email, count(*) as n from row_emails where not {_target('email')} group by 1, 2",
        "dedup_companies": f"with {_CONTACTS} select ord, company_name, website, source from contacts qualify row_number() over (partition by lower(trim(company_name)), lower(trim(website)) order by ord) = 1",
        "mx_summary": f"with {_MX} select domain, has_mx, mx_host, has_addr from domains",
        "verify_contacts": f"with {_VERIFIED} select ord, email, split_part(said, '|', 1) as status, split_part(said, '|', 2) as reason, split_part(said, '|', 1) in ('valid', 'unknown') as keep from said",
        "verify_counts": f"with {_VERIFIED} select split_part(said, '|', 1) as status, count(*) as n from said group by 1",
        "select_contacts": f"with {_CONTACTS}, {_picked(';')}, numbered as (select *, row_number() over (order by ord) as nth from picked where length(email) >= 6) select ord, company_name, email from numbered where nth > 10 and lower(email) not in (select lower(recipient_email) from ({D.as_sql(D.LOG)}) t)",
        "chunk_locations": f"with {_NTH_CITY} select ord, city from numbered where nth % 3 = 1",
        "plan_locations": f"with {_NTH_CITY}, rest as (select ord, city, row_number() over (order by ord) - 1 as again from numbered where nth >= 2) select ord, city from rest where again % 2 = 0 and city not in (select location from ({D.as_sql(D.OUTPUTS)}) t)",
        "limit_per_group": f"with {_CONTACTS} select niche, location, source, ord from contacts qualify row_number() over (partition by niche, location order by source, ord) <= 5",
        "fill_to_quota": f"""with {_CONTACTS}, hosts as (select niche, location, ord, source, {_HOST.format('website')} as host from contacts), chosen as (select * from hosts where source = 'OSM'),
            fresh as (select * from hosts h where source <> 'OSM' and not exists (select 1 from chosen c where c.niche = h.niche and c.location = h.location and c.host = h.host) qualify row_number() over (partition by niche, location, host order by ord) = 1),
            ranked as (select *, row_number() over (partition by niche, location order by ord) as nth from fresh)
            select niche, location, ord, host, false as fill from chosen union all
            select niche, location, ord, host, true from ranked r where nth <= 12 - (select count(*) from chosen c where c.niche = r.niche and c.location = r.location)""",
        "threshold_fallback": f"""with {_CONTACTS}, counted as (select *, count(*) filter (source = 'OSM') over (partition by niche, location) as n from contacts)
            select ord, niche, location, case when source = 'OSM' then 'strict' else 'relaxed' end as layer from counted where source = 'OSM' or (source = 'HERE' and n < 4)""",
        "niche_relevance": f"with {_ELEMENTS} select ord, ({_TAGGED} or {_RELEVANT}) as relevant, {_RELAXED} as relaxed from elements",
        "element_search": f"""with {_ELEMENTS}, found as (
            select type, id, ord, lat, lon, 1 as phase from elements where {_FOUND}
            union all select type, id, ord, lat, lon, 2 from elements where name <> '' and website <> '')
            select type, id, ord, phase from found where lat between 5 and 80 and lon between 10 and 170 qualify row_number() over (partition by type, id order by phase, ord) = 1""",
        "candidate_skips": f"""with {_ELEMENTS} select case when trim(name) = '' then 'no name' when website = '' or website = 'https://www.facebook.com/x' then 'no website' when not ({_TAGGED} or {_RELEVANT}) then 'not relevant' else 'none' end as skip_reason, count(*) as n from elements group by 1""",
        "merge_sources": _merge(),
        "merge_sources_greedy": _merge_greedy(),
        "located_elements": _located(),
        "niche_matches": _niche_matches(),
        "build_candidates": _candidates(12, 6, 8),
        "resolve_region": _REGIONS,
        "infer_pattern": f"""with {_CONTACTS}, spread as (select {_HOST.format('website')} as domain, lower(unnest({_cells('all_emails_found')})) as email from contacts),
            own as (select domain, email, split_part(email, '@', 1) as local from spread where {_domain('email')} = domain), said as (select *, {pattern} as pattern from own)
            select domain, coalesce(first(pattern order by not {_preferred('email')}, email) filter (pattern is not null), '{{first}}.{{last}}') as pattern from said group by domain""",
        "address_from_pattern": f"""with {_CONTACTS}, named as (select ord, {_HOST.format('website')} as domain, lower(split_part(contact_person, ' ', 1)) as first, lower(split_part(contact_person, ' ', 2)) as last from contacts)
            select ord, case when first = '' then '' else concat(case ord % 4 when 0 then concat(first, '.', last) when 1 then first when 2 then concat(first, '_', last) else concat(left(first, 1), last) end, '@', domain) end as address from named""",
        "render_text": "select conv_id, turn, concat('[', coalesce(role, ''), '] ', cast(turn as varchar), ': ', coalesce(text, ''), ' ') as line from conversations",
        "run_summary": f"with {_CONTACTS}, {_ROW_EMAILS}, sums as (select c.ord, c.niche, count(email) filter ({_target('email')}) as kept from contacts c left join row_emails r on c.ord = r.ord group by 1, 2) select niche, count(*) as total, count(*) filter (kept > 0) as with_emails, sum(kept)::bigint as total_emails from sums group by niche",
        "location_slugs": rf"with {_CONTACTS} select trim(regexp_replace(concat(niche, ', ', location), '[\\/:*?\"<>|, ]', '_', 'g'), '_') as slug, count(*) as n from contacts group by 1",
        "contact_preview": f"with {_CONTACTS} select ord, case when length(company_name) > 24 then concat(left(company_name, 22), '..') else company_name end as company_name, case when length(all_emails_found) > 24 then concat(left(all_emails_found, 22), '..') else all_emails_found end as all_emails_found from contacts order by ord limit 10",
        "clean_stream": _clean(False),
        "suppress_stream": f"select distinct concat('info@co', cast(user_id * 3 as varchar), '.test') as email from events where concat('info@co', cast(user_id * 3 as varchar), '.test') not in (select lower(recipient_email) from ({D.as_sql(D.LOG)}) t)",
        "clean_file_stream": "select company_name, contact_email, all_emails_found from ("
        + _clean(False).replace(_CONTACTS, _CONTACTS.replace("contacts as (", "rows_of as (", 1) + ", contacts as (select * replace (case when ord % 2 = 0 then contact_email else '' end as contact_email) from rows_of)", 1)
        + ") t",
        "suppress_expiring": """with recursive told as (select distinct 'info@co' || user_id || '.test' as email_key, ts, event_id % 10 = 3 and day(ts) // 8 < 2 as late from events),
            chain as (select email_key, min(ts) as ts from told where not late group by 1 union all
              select c.email_key, min(t.ts) from chain c join told t on t.email_key = c.email_key and not t.late and t.ts >= c.ts + interval 1 day group by c.email_key, c.ts)
            select email_key, epoch_us(ts) as at, false as late from chain union all select email_key, epoch_us(ts), true from told where late""",
        "processed_log_stream": "select concat('info@co', cast(o_custkey as varchar), '.test') as recipient_email, count(*) as n from orders group by 1",
        "people_extract": f"with {_PEOPLE_PAGES}, {_people()} select site, (row_number() over (partition by site order by score, name, title) - 1)::int as pos, score::int as score, name, title from people",
        "harvest_pages": _harvest(),
        "harvest_planned": _harvest(_planned(), "site, page_ord"),
        "page_plan_hinted": _page_plan(16, C.CONTACT_HINTS),
        "page_plan": _page_plan(16),
        "result_links": _result_links(),
        "place_rows": """select (p_partkey // 2)::varchar as id, trim(p_name) as name, concat('https://p', cast(p_partkey as varchar), '.test') as website, cast(p_partkey as varchar) as phone from part
            where p_partkey % 9 <> 0 and trim(p_name) <> '' qualify row_number() over (partition by p_partkey // 2 order by trim(p_name), website, phone) = 1""",
        "run_all_locations": _all_locations(),
        "run_all_located": _all_located(),
        "founders_of_pages": _founders(D.MENTIONS, D.FIRMS),
        "second_search": _second_search(6),
        "run_locations": f"""with {_CONTACTS}, cleaned as ({_clean(False).replace("with " + _CONTACTS + ",", "with")}),
            once as (select c.ord, c.niche, c.location, c.source, c.company_name, d.contact_email from cleaned d join contacts c on c.ord = d.ord qualify row_number() over (partition by lower(trim(c.company_name)), lower(trim(c.website)) order by c.ord) = 1)
            select niche, location, ord, company_name, contact_email from once where location not in (select location from ({D.as_sql(D.NATION_OUTPUTS)}) t) qualify row_number() over (partition by niche, location order by source, ord) <= 20""",
    }
