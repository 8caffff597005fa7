"""Column functions: text, addresses, URLs, HTML, phones and names.

All are built-in expressions but `html_unescape` and `url_join`, which have no
built-in equal and go to Arrow batches only where a text needs them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cardfile.functions import constants as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body names it; Python functions may stand in value only."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def trimmed(c: Column | str) -> Column:
    """Without white space, Unicode's too, at either end."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def clean_value(c: Column | str) -> Column:
    return F.coalesce(trimmed(c), F.lit(""))


# --- addresses


def email_domain(c: Column | str) -> Column:
    """Lower-case text after the first @; null without one."""
    c = _col(c)
    return F.when(F.instr(c, "@") > 0, F.lower(F.substr(c, F.instr(c, "@") + 1)))


def email_local(c: Column | str) -> Column:
    return F.substring_index(_col(c), "@", 1)


def split_emails(c: Column | str, separators: str = ";,") -> Column:
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), f"[{separators}]"), trimmed)
    return F.filter(parts, lambda x: x != "")


def join_emails(c: Column | str) -> Column:
    return F.array_join(_col(c), "; ")


def is_ascii(c: Column | str) -> Column:
    return ~_col(c).rlike(r"[^\x00-\x7F]")


def is_valid_email(c: Column | str) -> Column:
    """No blank, exactly one @, and a dot after it."""
    c = _col(c)
    return ~c.rlike(r"(?U)\s") & (F.size(F.split(c, "@")) == 2) & F.coalesce(F.contains(email_domain(c), F.lit(".")), F.lit(False))


def is_spam_or_irrelevant(c: Column | str) -> Column:
    c = F.lower(_col(c))
    domain = F.coalesce(email_domain(c), F.lit(""))
    return (
        c.rlike(rf"\.({'|'.join(C.IMAGE_SUFFIXES)})$") | domain.rlike(r"^\d+\.\d+\.\d+\.\d+$") | domain.isin(*C.PLACEHOLDER_DOMAINS)
        | domain.rlike(r"\b(tracking|analytics|marketing|newsletter|mailchimp)\b") | (F.length(email_local(c)) > 40)
    )


def is_valid_target_email(c: Column | str, strict: bool = False, junk: Sequence[str] = C.JUNK_PATTERNS) -> Column:
    """Address worth keeping; junk: patterns searched anywhere in it."""
    c = F.lower(trimmed(c))
    parts = F.split(c, "@")
    domain = F.coalesce(email_domain(c), F.lit(""))
    ok = (F.size(parts) > 1) & F.contains(F.get(parts, F.lit(1)), F.lit(".")) & ~c.rlike(r"@.*\d+\.\d+\.\d+") & ~F.contains(domain, F.lit(".www.")) & ~F.startswith(domain, F.lit("www.")) & is_ascii(c)
    if junk:
        ok = ok & ~c.rlike("|".join(junk))
    if strict:
        local = email_local(c)
        ok = ok & (F.length(local) >= 2) & ~local.rlike("^[a-f0-9]{6,}$") & ~local.rlike(r"^\d+[a-z]") & (F.length(domain) >= 6)
    return F.coalesce(ok, F.lit(False))


def is_preferred_email(c: Column | str) -> Column:
    return F.lower(_col(c)).rlike(f"^({'|'.join(C.PREFERRED_PREFIXES)})")


def sort_emails(c: Column | str) -> Column:
    """Preferred addresses first, each part in order."""
    ranked = F.array_sort(F.transform(_col(c), lambda e: F.struct((~is_preferred_email(e)).alias("late"), e.alias("email"))))
    return F.transform(ranked, lambda x: x["email"])


def distinct_emails(c: Column | str) -> Column:
    """Distinct by lower case; the first spelling stays."""
    none = F.array().cast("array<string>")
    return F.aggregate(_col(c), none, lambda kept, e: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(e)), kept).otherwise(F.concat(kept, F.array(e))))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.contains(c, F.lit("&")), _unescaped(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


_AT_OR_DOT = r"(?i)[\[(](?:at|dot)[\])]"


def deobfuscate(c: Column | str, unescape: bool = True, collapse_dots: bool = True) -> Column:
    """Plain addresses from ` [at] `, `(dot)`, ` @ ` and the like."""

    def words(c: Column) -> Column:
        for word, sign in (("at", "@"), ("dot", ".")):
            c = F.regexp_replace(c, rf"(?i)(?:\G|(?<!\s))\s*(\[{word}\]|\({word}\))\s*", sign)
        return c

    def signs(c: Column) -> Column:
        c = F.regexp_replace(c, r"(?:\G|(?<!\s))\s+@\s+", "@")
        return F.regexp_replace(c, r"(?:\G|(?<!\s))\s+\.\s+", ".") if collapse_dots else c

    # a replacement looks through all white space of a text, so it only runs where there is something to replace,
    # and begins where a run of white space begins or the last match ended: elsewhere it would try the same run again
    plain = _bound(html_unescape(c) if unescape else _col(c), lambda t: F.when(t.rlike(_AT_OR_DOT), words(t)).otherwise(t))
    return _bound(plain, lambda t: F.when(t.rlike(r"\s[@.]\s"), signs(t)).otherwise(t))


def extract_emails(c: Column | str, **settings) -> Column:
    """Addresses of a text in order, lower-cased, no spam, repeats included."""

    def found(t: Column) -> Column:
        every = F.regexp_extract_all(deobfuscate(t, **settings | {"unescape": False}), F.lit(r"(?:\G|(?<![a-zA-Z0-9_.+-]))" + C.EMAIL), 0)
        return F.transform(F.filter(every, lambda e: is_valid_email(e) & ~is_spam_or_irrelevant(e)), F.lower)

    text = html_unescape(c) if settings.get("unescape", True) else _col(c)
    none = F.when(_col(c).isNotNull(), F.array().cast("array<string>"))
    return _bound(text, lambda t: F.when(F.contains(t, F.lit("@")) | t.rlike(_AT_OR_DOT), found(t)).otherwise(none))


def email_pattern(local: Column) -> Column:
    """What one local part says about how its company builds addresses."""
    letters = r"^\p{L}+$"
    return F.when(local.rlike(r"^\p{L}+\.\p{L}+$"), "{first}.{last}").when(local.rlike(letters) & (F.length(local) > 2), "{first}").when(local.rlike(r"^\p{L}+_\p{L}+$"), "{first}_{last}")


def address_from_pattern(name: Column | str, domain: Column | str, pattern: Column | str) -> Column:
    """A guess at a person's address; one word gives word@domain, none gives ''."""
    words = F.filter(F.split(F.lower(trimmed(name)), r"(?U)\s+"), lambda w: w != "")
    first, last, pattern = F.get(words, F.lit(0)), F.element_at(words, -1), _col(pattern)
    start, end = F.left(first, F.lit(1)), F.left(last, F.lit(1))
    forms = {
        "{first}": first, "{last}": last, "{f}": start, "{l}": end, "{first}_{last}": F.concat(first, F.lit("_"), last), "{f}{last}": F.concat(start, last),
        "{first}{last}": F.concat(first, last), "{first}.{l}": F.concat(first, F.lit("."), end), "{last}.{first}": F.concat(last, F.lit("."), first),
    }
    local = reduce(lambda chain, kv: chain.when(pattern == kv[0], kv[1]), list(forms.items())[1:], F.when(pattern == "{first}", first)).otherwise(F.concat(first, F.lit("."), last))
    return F.when(F.size(words) == 0, "").when(F.size(words) == 1, F.concat(first, F.lit("@"), _col(domain))).otherwise(F.concat(local, F.lit("@"), _col(domain)))


# --- phones


def normalize_phone(c: Column | str) -> Column:
    """+ form, or a national number as it stands; null for others."""
    digits = F.regexp_replace(_col(c), r"[\s\-/().,]", "")
    return F.when(F.startswith(digits, F.lit("+")), digits).when(F.startswith(digits, F.lit("00")), F.concat(F.lit("+"), F.substr(digits, F.lit(3)))).when(F.startswith(digits, F.lit("0")), digits)


def is_valid_phone(c: Column | str) -> Column:
    """A + number whose length fits its country code, the longest known one."""
    c = _col(c)
    digits = F.regexp_replace(c, r"\D", "")
    least = F.create_map(*[F.lit(x) for pair in C.COUNTRY_DIGITS.items() for x in pair])
    of = [(n, F.try_element_at(least, F.left(digits, F.lit(n)))) for n in (3, 2, 1)]
    need = F.coalesce(*[d for _, d in of])
    size = F.when(of[0][1].isNotNull(), 3).when(of[1][1].isNotNull(), 2).otherwise(1)
    rest = F.length(digits) - size
    fits = F.when(F.left(digits, size) == "1", rest == need).otherwise((rest >= need) & (rest <= need + 1))
    return F.coalesce(F.startswith(c, F.lit("+")) & F.length(digits).between(8, 16) & need.isNotNull() & fits, F.lit(False))


def extract_phones(c: Column | str) -> Column:
    """Distinct numbers of a text in order: national ones unchecked, + ones valid."""
    found = F.transform(F.regexp_extract_all(_col(c), F.lit(C.PHONE), 0), normalize_phone)
    return F.array_distinct(F.filter(found, lambda p: p.isNotNull() & (~F.startswith(p, F.lit("+")) | is_valid_phone(p))))


# --- URLs and HTML


def normalize_url(c: Column | str) -> Column:
    c = trimmed(c)
    full = F.when(F.startswith(c, F.lit("//")), F.concat(F.lit("https:"), c)).when(c.rlike("(?i)^https?://"), c).when(c == "", "").otherwise(F.concat(F.lit("https://"), c))
    return F.regexp_replace(full, "/+$", "")


def default_scheme(c: Column | str) -> Column:
    c = clean_value(c)
    return F.when((c == "") | F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit("https://"), c))


def url_host(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(_col(c), F.lit("AUTHORITY"))), F.lit(""))


def url_domain(c: Column | str) -> Column:
    return F.regexp_replace(url_host(c), r"^www\.", "")


def is_directory_host(host: Column, hosts: Sequence[str], match: str = "suffix") -> Column:
    """match: 'suffix' on a label boundary, or 'substring' anywhere."""
    if match == "substring":
        return F.exists(_literals(hosts), lambda h: F.contains(host, h))
    return host.rlike(rf"(^|\.)({'|'.join(h.replace('.', '[.]') for h in hosts)})$")


@F.pandas_udf(StringType())
def _joined(bases: pd.Series, links: pd.Series) -> pd.Series:
    def join(base: str | None, link: str | None) -> str | None:
        if base is None or link is None:
            return None
        try:
            return urljoin(base, link)
        except ValueError:
            return None

    return pd.Series([join(b, x) for b, x in zip(bases, links)], dtype="object")


def url_join(base: Column | str, link: Column | str) -> Column:
    """Absolute form of a link; dot segments and plain relative links go to an Arrow batch."""
    base, link = _col(base), _col(link)
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    plain = (root != "") & ~F.contains(link, F.lit("./")) & ~link.rlike(r"/\.{1,2}$")
    rooted = plain & F.startswith(link, F.lit("/")) & ~F.startswith(link, F.lit("//"))
    whole = link.rlike("(?i)^https?://") & ~F.contains(link, F.lit("./"))
    odd = ~F.coalesce(rooted | whole, F.lit(False))
    return F.when(whole, link).when(rooted, F.concat(root, link)).otherwise(_joined(F.when(odd, base), F.when(odd, link)))


def html_to_text(c: Column | str) -> Column:
    c = F.regexp_replace(_col(c), r"(?is)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"(?U)\s+", " "))


_ANCHOR = r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""


def page_anchors(c: Column | str) -> Column:
    """Array of struct (href, text) of a page's links, text lower-cased without tags."""
    c = _col(c)
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(_ANCHOR), 1).alias("href"), F.regexp_extract_all(c, F.lit(_ANCHOR), 2).alias("text"))
    return F.transform(both, lambda x: F.struct(F.btrim(x["href"]).alias("href"), F.lower(F.regexp_replace(x["text"], r"<[^>]+>", " ")).alias("text")))


def hinted_anchors(c: Column | str, hints: Sequence[str] = C.CONTACT_HINTS) -> Column:
    """Links that may lead to contact data: no anchor or scheme links, a hint in address or text (any, if hints is empty)."""
    pattern = "|".join(re.escape(h) for h in hints)
    return F.filter(page_anchors(c), lambda x: (x["href"] != "") & ~x["href"].rlike("^(#|mailto:|tel:|javascript:|data:)") & F.concat_ws(" ", F.lower(x["href"]), x["text"]).rlike(pattern))


def candidate_page_urls(base: Column | str) -> Column:
    return F.array_distinct(F.transform(_literals(C.CONTACT_PATHS), lambda p: F.concat(normalize_url(base), p)))


def unwrap_redirect(c: Column | str) -> Column:
    """The decoded `uddg` address of a redirect link, else the link."""
    c = _col(c)
    full = F.when(F.startswith(c, F.lit("//")), F.concat(F.lit("https:"), c)).otherwise(c)
    return F.coalesce(F.try_url_decode(F.try_parse_url(full, F.lit("QUERY"), F.lit("uddg"))), c)


# --- names, titles, niches


#: Control characters that mark titles in a text.
TITLE_START, TITLE_END = "\x01", "\x02"


def any_title(whole_word: bool = False) -> str:
    body = "|".join(p for _, p in C.TITLES)
    return rf"(?iU)\b(?:{body})\b" if whole_word else f"(?iU)(?:{body})"


def title_rank(c: Column | str) -> Column:
    c = F.lower(trimmed(c))
    (rank, pattern), *others = C.TITLES
    return reduce(lambda chain, t: chain.when(c.rlike(f"(?U){t[1]}"), t[0]), others, F.when(c.rlike(f"(?U){pattern}"), rank)).otherwise(999)


def is_person_name(c: Column | str, non_names: Sequence[str] = C.NON_NAMES, non_words: Sequence[str] = C.NON_NAME_WORDS) -> Column:
    """One to three words, none of them a heading's; non_names are whole names that count as none, some given names among the defaults."""
    c = F.lower(trimmed(c))
    words = F.split(c, r"(?U)\s+")
    return ~c.isin(*non_names) & F.size(words).between(1, 3) & ~F.arrays_overlap(words, _literals(non_words))


def extract_people(c: Column | str, reach: int = 60, whole_word: bool = False) -> Column:
    """Array of struct (score, name, title): names near titles, and headings followed by a block.

    The text before each title is the last `reach` characters of what was
    folded so far, and the text after it the first of what follows; a name once
    found is not found again. Sorted by score, then name.
    """
    title = any_title(whole_word)
    name = f"(?U){C.PERSON_NAME}"
    start = F.struct(F.lit("").alias("tail"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        window = F.right(F.concat(acc["tail"], x["part"]), F.lit(reach))
        return F.struct(F.right(F.concat(window, x["title"]), F.lit(reach)).alias("tail"), F.concat(acc["out"], F.array(window)).alias("out"))

    def back(acc: Column, x: Column) -> Column:
        window = F.left(F.concat(x["part"], acc["tail"]), F.lit(reach))
        return F.struct(F.left(F.concat(x["title"], window), F.lit(reach)).alias("tail"), F.concat(F.array(window), acc["out"]).alias("out"))

    def around(pieces: Column) -> Column:
        """The names before and after each title; a piece is a title, its end mark and the text up to the next one."""
        titled = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        both = F.transform(titled, lambda p: F.struct(F.substring_index(p, TITLE_END, 1).alias("title"), F.substr(p, F.instr(p, TITLE_END) + 1).alias("part")))

        def windows(both: Column) -> Column:
            earlier = F.transform(both, lambda x, i: F.struct(F.when(i == 0, F.get(pieces, F.lit(0))).otherwise(F.get(both, i - 1)["part"]).alias("part"), x["title"].alias("title")))
            before, after = F.aggregate(earlier, start, step, lambda acc: acc["out"]), F.aggregate(F.reverse(both), start, back, lambda acc: acc["out"])
            return F.concat(
                F.zip_with(before, both, lambda w, x: F.struct(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(w, F.lit(name), 0)), -1).alias("name"), x["title"].alias("title"))),
                F.zip_with(after, both, lambda w, x: F.struct(F.regexp_extract(w, name, 0).alias("name"), x["title"].alias("title"))),
            )

        return _bound(both, windows)

    # titles are marked in one pass over the text, and found again by their marks
    marked = F.regexp_replace(F.translate(html_to_text(c), TITLE_START + TITLE_END, ""), title, TITLE_START + "$0" + TITLE_END)
    rows = [_bound(F.split(marked, TITLE_START, -1), around)]
    heading = r"(?is)<h[2-6][^>]*>([^<]{2,50})</h[2-6]>[^<]*(?:<p[^>]*>[^<]{0,150}</p>|<div[^>]*>[^<]{0,150}</div>)"
    heads = F.zip_with(F.regexp_extract_all(_col(c), F.lit(heading), 1), F.regexp_extract_all(_col(c), F.lit(heading), 0), lambda h, whole: F.struct(F.regexp_extract(F.btrim(h), f"(?U)^{C.PERSON_NAME}", 0).alias("name"), F.regexp_extract(F.substr(whole, F.length(h) + 5), title, 0).alias("title")))
    rows.append(F.transform(heads, lambda x: F.struct(x["name"].alias("name"), F.when(x["title"] == "", "Team Member").otherwise(x["title"]).alias("title"))))
    found = F.filter(F.concat(*rows), lambda x: (x["name"] != "") & is_person_name(x["name"]))
    none = F.array().cast("array<struct<name:string,title:string>>")
    once = F.aggregate(found, none, lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k["name"]) == F.lower(x["name"])), kept).otherwise(F.concat(kept, F.array(x))))
    return F.array_sort(F.transform(once, lambda x: F.struct(title_rank(x["title"]).alias("score"), x["name"].alias("name"), trimmed(x["title"]).alias("title"))))


def niche_keywords(c: Column | str) -> Column:
    """Each phrase of a niche, then its words of two or more letters, distinct."""
    phrases = F.filter(F.transform(F.split(F.lower(_col(c)), "[,/&]+"), trimmed), lambda p: p != "")
    return F.array_distinct(F.flatten(F.transform(phrases, lambda p: F.concat(F.array(p), F.filter(F.split(p, r"(?U)\s+"), lambda w: F.length(w) > 1)))))


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")


def is_relevant(name: Column | str, tags: Column | str, niche_tags: Column | str, keywords: Column | str, terms: Column | str) -> Column:
    """A mapped tag (office=company is neutral), a whole keyword, or a whole related term; two-letter keywords only begin a name."""
    name, tags = F.lower(F.coalesce(_col(name), F.lit(""))), _col(tags)

    def tagged(t: Column) -> Column:
        return (t != "office=company") & (F.lower(F.try_element_at(tags, F.substring_index(t, "=", 1))) == F.substr(t, F.instr(t, "=") + 1))

    by_tag = F.coalesce(F.exists(_col(niche_tags), lambda t: F.coalesce(tagged(t), F.lit(False))), F.lit(False))
    short = lambda k: F.regexp_like(name, F.concat(F.lit("^"), _quoted(k), F.lit(r"([\s\-]|$)")))
    whole = lambda k: F.regexp_like(name, F.concat(F.lit(r"\b"), _quoted(k), F.lit(r"\b")))
    by_keyword = F.exists(_col(keywords), lambda k: F.when(F.length(k) <= 2, short(k)).otherwise(whole(k)))
    return by_tag | ((name != "") & (by_keyword | F.coalesce(F.exists(_col(terms), whole), F.lit(False))))


def is_relaxed_match(name: Column | str, keywords: Column | str, terms: Column | str) -> Column:
    """Any keyword or term of three or more letters anywhere in the name."""
    name = F.lower(F.coalesce(_col(name), F.lit("")))
    within = lambda k: (F.length(k) >= 3) & F.contains(name, k)
    return F.exists(_col(keywords), within) | F.coalesce(F.exists(_col(terms), within), F.lit(False))


# --- places, records, templates


def bbox_span(south: Column | str, north: Column | str, west: Column | str, east: Column | str) -> Column:
    lat, lon = _col(north) - _col(south), _col(east) - _col(west)
    return F.struct(lat.alias("lat"), lon.alias("lon"), (lat * 111).alias("lat_km"), (lon * 111).alias("lon_km"))


def is_poi(osm_type: Column | str, south, north, west, east) -> Column:
    span = bbox_span(south, north, west, east)
    return F.coalesce(_col(osm_type).isin(*C.POI_TYPES), F.lit(False)) | ((span["lat"] < 0.02) & (span["lon"] < 0.02))


def within_bbox(lat, lon, south, north, west, east) -> Column:
    return _col(lat).between(_col(south), _col(north)) & _col(lon).between(_col(west), _col(east))


def region_candidates(display: Column | str, location: Column | str) -> Column:
    """Names to try next: the last two parts, the last part, and the last part of what was asked; distinct, no blanks."""
    parts = F.transform(F.split(_col(display), ","), trimmed)
    last = F.element_at(parts, -1)
    two = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ", "))
    asked = F.element_at(F.transform(F.split(_col(location), ","), trimmed), -1)
    return F.filter(F.array_distinct(F.array_compact(F.array(two, last, asked))), lambda x: x != "")


def parse_mx(c: Column | str) -> Column:
    """struct (preference, host) of `10 host.`; null for the null MX and for malformed data."""
    parts = F.split(F.btrim(_col(c)), r"\s+")
    host = F.regexp_replace(F.get(parts, F.lit(1)), r"\.+$", "")
    preference = F.get(parts, F.lit(0)).try_cast("int")
    return F.when(preference.isNotNull() & (F.coalesce(host, F.lit("")) != ""), F.struct(preference.alias("preference"), host.alias("host")))


def slug(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(_col(c), r'[\\/:*?"<>|, ]', "_"), F.lit("_"))


def render_template(template: Column | str, values: dict[str, Column]) -> Column:
    """{key} replaced by its value, '' for null."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), _col(template))


def verify_status(strict_ok: Column, has_mx: Column, mx_host: Column, has_addr: Column, domain: Column, accepted: Column, mx_only: bool = False) -> Column:
    """struct (status, reason) of an address; null lookups are unknown."""

    def said(status: str, *reason) -> Column:
        return F.struct(F.lit(status).alias("status"), F.concat(*[r if isinstance(r, Column) else F.lit(r) for r in reason]).alias("reason"))

    out = F.when(~strict_ok, said("invalid", "fails format / junk checks")).when(has_mx.isNull(), said("unknown", "DNS lookup failed (network / resolver)"))
    out = out.when(~has_mx & has_addr, said("unknown", "no MX record but domain resolves (A-record fallback)")).when(~has_mx & has_addr.isNull(), said("unknown", "no MX record; could not confirm A/AAAA record"))
    out = out.when(~has_mx, said("invalid", "domain cannot receive mail (no MX, no A/AAAA record)")).when(domain.isin(*C.KNOWN_PROVIDERS), said("valid", "known provider with MX records"))
    if mx_only:
        return out.otherwise(said("valid", "domain has MX records (SMTP probe skipped)"))
    out = out.when(accepted, said("valid", "mailbox accepted by ", mx_host)).when(~accepted, said("invalid", "mailbox rejected by ", mx_host, " (550)"))
    return out.otherwise(said("unknown", "mail server ", mx_host, " did not confirm (blocked / timeout)"))


def founder_source(has_person: Column, from_site: Column) -> Column:
    """website or search for a person found there, else none."""
    return F.when(has_person & from_site, "website").when(has_person, "search").otherwise("none")
