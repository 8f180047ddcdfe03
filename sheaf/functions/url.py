"""URL functions as Column expressions: parts, canonical forms, page state and route policy."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin as _join

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query keys that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
#: Query keys of page state; those counting from one; those counting rows.
GENERIC_PAGE_KEYS = ("page", "p", "pg", "page_num", "pagenumber")
PAGE_KEYS = ("page", "pg", "pagenum", "page_number", "offset", "start")
ONE_BASED = ("page", "pg", "pagenum", "page_number")
OFFSETS = ("start", "offset")
#: Route and query patterns.
NOISE_QUERY = (
    r"(?i)^(?:utm_[a-z_]*|gclid|gbraid|wbraid|dclid|fbclid|msclkid|ttclid|twclid|igshid|yclid|s_kwcid|mc_cid|mc_eid|srsltid|_ga|_gl|_hsenc|_hsmi|"
    r"hsa_[a-z]+|ref|referrer|referer|sid|sessionid|session_id|phpsessid|jsessionid|aspsessionid|cfid|cftoken|sort|sortby|sort_by|order|orderby|"
    r"page|pg|pagenum|start|offset|limit|per_page|perpage|view|display|layout|campaign|cmp|adgroup|keyword|matchtype|placement|creative|clickid|"
    r"affid|_|cb|cachebust|nocache)$"
)
SPECIAL_PATH = (
    r"(?i)(?:^|/)(?:specials?|offers?|incentives?|service|parts|finance|credit|research|compare|trade-in|value-your-trade|contact|about|careers?|"
    r"news|blog|privacy|terms|sitemap|login|account|schedule|directions)(?:/|$)"
)
FILTER_QUERY = r"(?i)^(?:make|model|trim|year|minyear|maxyear|price|minprice|maxprice|body|bodystyle|condition|type|fuel|transmission|drivetrain|color|filter|facet)$"
DETAIL_ROUTE = r"(?i)(?:^|/)(?:vdp|view-?details?|vehicle|vehicle-?details?|details?/vehicle|inventory/(?:details?|vehicle))(?:/|$)"
LISTING_TAIL = (
    r"(?i)^(?:inventory|vehicles?|autos?|cars?|new|used|preowned|pre-owned|certified|search|results?|featured-vehicles?|demo-inventory|"
    r"used-inventory|new-inventory|saved-vehicles?|mysavedvehicles)$"
)
CATEGORY_PATH = r"(?i)(?:^|/)(?:category|collections?|lifestyle|promotions?|research)(?:/|$)"
ACTION_QUERY = r"(?i)(?:^|[?&])(?:ai_(?:ask_about|slide_show)|modal|compare|save|share|lead|form|print|request_?info|test_?drive|trade_?in)(?:=|&|$)"
ACTION_PATH = (
    r"(?i)(?:^|/)(?:contact(?:-?us)?(?:-?form)?|contactusform|request-?(?:info|quote)|get-?(?:e?price|quote)|schedule-?(?:test-?drive|service)|"
    r"test-?drive|trade-?in|value-?(?:your-?)?trade|lead-?form|finance-?application|compare|saved?-?vehicles?)(?:/|$)"
)
TEMPLATE = r"(?i)(?:\{\{|\}\}|\$\{|<%|%>|&#0*123;|&#x0*7b;|&#0*125;|&#x0*7d;)"
INVENTORY_PATH = r"(?i)(?:^|[/_-])(?:used|preowned|pre-owned|inventory|vehicles?|autos?|cars)(?:[/_.-]|$)"


def _part(u: Column, pattern: str) -> Column:
    return F.regexp_extract(u, pattern, 1)


def scheme(u: Column) -> Column:
    return F.lower(_part(u, r"^([A-Za-z][A-Za-z0-9+.-]*):"))


def netloc(u: Column) -> Column:
    return F.lower(_part(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"))


def host(u: Column) -> Column:
    return _host(netloc(u))


def _host(n: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(n, r"^.*@", ""), r":\d*$", "")


def path(u: Column) -> Column:
    return _part(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)")


def query(u: Column) -> Column:
    return _part(u, r"^[^?#]*\?([^#]*)")


def fragment(u: Column) -> Column:
    return _part(u, r"#(.*)$")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that it names more than once, evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def resolve(base: Column, ref: Column) -> Column:
    """A reference as an absolute URL: of its own scheme, of the page's host, path, folder or query; dot segments are resolved."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    whole = (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("?"), F.concat(root, path(base), ref))
        .when(ref.startswith("#"), F.concat(F.split_part(base, F.lit("#"), F.lit(1)), ref))
        .otherwise(F.concat(root, folder, ref))
    )

    def undotted(u: Column) -> Column:
        kept = F.aggregate(F.split(path(u), "/"), F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1)))).when(x == ".", s).otherwise(F.array_append(s, x)))
        ends = F.when(path(u).rlike(r"/\.{1,2}$"), "/").otherwise("")
        dotted = F.concat(F.regexp_extract(u, r"^([^:]*://[^/?#]*)", 1), F.array_join(kept, "/"), ends, F.regexp_extract(u, r"^[^?#]*(.*)$", 1))
        return F.when(path(u).rlike(r"(?:^|/)\.{1,2}(?:/|$)"), dotted).otherwise(u)

    return _let(whole, undotted)


#: What a reference may not hold, and the characters that need no percent-encoding in paths and queries.
UNSAFE = r"\\|[\x00-\x1f\x7f]"
PATH_SAFE, QUERY_SAFE = r"[A-Za-z0-9/%:@!$&'()*+,;=._~-]", r"[A-Za-z0-9%=&?/:;+,@!$'()*._~\[\]-]"


def _usable(ref: Column) -> Column:
    return (F.trim(ref) != "") & ~template_marker(ref) & ~ref.rlike(UNSAFE)


def _after_host(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^:]*://[^/?#]*(.*)$", 1)


def _port(u: Column) -> Column:
    return F.regexp_extract(netloc(u), r":(\d+)$", 1)


def same_origin_url(base: Column, ref: Column, wanted: Column | None, keep_fragment: bool = False) -> Column:
    """A link of the wanted origin (None: of any), sanitised; a plain http link of the same host is taken as https."""

    def own(u: Column) -> Column:
        if wanted is None:
            return F.when(origin(u).isNotNull(), u)
        upgradable = (scheme(u) == "http") & (scheme(wanted) == "https") & (host(u) == host(wanted)) & _port(u).isin("", "80") & ~netloc(u).contains("@")
        return F.when(origin(u) == wanted, u).when(upgradable & (F.concat(F.lit("https://"), host(u)) == wanted), F.concat(F.lit("https://"), host(u), _after_host(u)))

    def clean(u: Column) -> Column:
        plain = _with_query(F.concat(scheme(u), F.lit("://"), netloc(u), F.when(path(u) == "", "/").otherwise(path(u))), query(u))
        return F.when(fragment(u) != "", F.concat(plain, F.lit("#"), fragment(u))).otherwise(plain) if keep_fragment else plain

    whole = F.when(_usable(ref), resolve(base, F.trim(ref)))
    return _let(_let(whole, lambda u: F.when(~template_marker(u), own(u))), clean)


def without_www(u: Column) -> Column:
    return F.regexp_replace(host(u), r"^www\.", "")


def dealer_url(base: Column, ref: Column, wanted: Column) -> Column:
    """A link that a dealer's page may hint at: sanitised, of the dealer's host with or without www., http taken as https."""
    folded = lambda u: F.regexp_replace(origin(u), r"//www\.", "//")
    upgraded = lambda u: F.when((scheme(u) == "http") & (scheme(wanted) == "https") & _port(u).isin("", "80"), F.concat(F.lit("https://"), host(u), _after_host(u))).otherwise(u)
    return _let(_let(same_origin_url(base, ref, None), upgraded), lambda u: F.when(folded(u) == folded(wanted), u))


def _quoted(c: Column, safe: str) -> Column:
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(safe), x).otherwise(F.replace(encode(x), F.lit("+"), F.lit("%20")))), "")


def safe_data_url(base: Column, ref: Column) -> Column:
    """An http(s) URL of any host for data such as images, percent-encoded once; broken escapes and user information give none."""

    def clean(u: Column) -> Column:
        broken = F.concat(path(u), F.lit(" "), query(u)).rlike("%(?![0-9A-Fa-f]{2})")
        good = scheme(u).isin("http", "https") & (host(u) != "") & ~netloc(u).contains("@") & ~broken & ~template_marker(u)
        return F.when(good, _with_query(F.concat(scheme(u), F.lit("://"), netloc(u), _quoted(path(u), PATH_SAFE)), _quoted(query(u), QUERY_SAFE)))

    return _let(F.when(_usable(ref), resolve(base, F.trim(ref))), clean)


def url_list(values: Column) -> Column:
    """URLs as a user lists them: trimmed, https where no scheme is given, each once in the order given."""
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return F.array_distinct(F.transform(trimmed, lambda v: F.when(v.contains("://"), v).otherwise(F.concat(F.lit("https://"), v))))


def stock_keys(values: Column) -> Column:
    """Stock keys as URL tails spell them: decoded, in lower case, with a digit, each once and sorted."""
    plain = F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.lower(F.trim(decode(F.replace(v, F.lit("+"), F.lit("%2B"))))))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda k: k.rlike(r"^[a-z0-9][a-z0-9-]{2,23}$") & k.rlike(r"\d"))))


#: Fixed value: query keys that say how a detail page is shown, not which vehicle it is of.
PRESENTATION = ("finance_type", "payment_type")


def same_advertised(requested: Column, advertised: Column) -> Column:
    """Whether two detail identities (see normalize_detail_url) name one page: equal, of one telling slug, or shown in another way."""
    tail = lambda i: F.lower(F.regexp_extract(F.regexp_replace(F.regexp_extract(i, r"^[^/?#]*([^?#]*)", 1), "/+$", ""), "([^/]*)$", 1))
    site = lambda i: F.lower(F.regexp_extract(i, r"^([^/?#]*)", 1))
    slug = (site(requested) == site(advertised)) & (tail(requested) == tail(advertised)) & (F.length(tail(requested)) >= 12) & tail(requested).contains("-") & tail(requested).rlike(r"\d")
    bare = lambda i: F.split_part(i, F.lit("?"), F.lit(1))
    told = lambda i: F.array_sort(F.filter(pairs(query(i)), lambda p: ~F.lower(p["key"]).isin(*PRESENTATION)))
    shown = (bare(requested) == bare(advertised)) & (F.to_json(F.struct(told(requested).alias("q"))) == F.to_json(F.struct(told(advertised).alias("q"))))
    return F.coalesce((requested == advertised) | slug | shown, F.lit(False))


def decode(c: Column) -> Column:
    """Percent-encoding undone, + as a blank; a text with a broken escape stays. Only texts with % or + are worked on."""
    return _let(c, lambda x: F.when(x.contains("%") | x.contains("+"), F.coalesce(F.try_url_decode(x), x)).otherwise(x))


def encode(c: Column) -> Column:
    """Percent-encoding of everything but letters, digits and _.-~, a blank as +."""
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return _let(c, lambda x: F.when(x.rlike(r"^[A-Za-z0-9_.~-]*\z"), x).otherwise(coded(x)))


def pairs(q: Column) -> Column:
    """Decoded (key, value) of a query, blank values kept, in order."""
    return F.transform(
        F.filter(F.split(q, "&"), lambda x: x != ""),
        lambda x: F.struct(decode(_part(x, "^([^=]*)")).alias("key"), decode(_part(x, "^[^=]*=(.*)$")).alias("value")),
    )


def _joined(found: Column, blank: str) -> Column:
    coded = lambda c: encode(c) if blank == "+" else F.replace(encode(c), F.lit("+"), F.lit(blank))
    return F.array_join(F.transform(found, lambda p: F.concat(coded(p["key"]), F.lit("="), coded(p["value"]))), "&")


def _with_query(base: Column, q: Column) -> Column:
    return _let(q, lambda x: F.when(x != "", F.concat(base, F.lit("?"), x)).otherwise(base))


def canonical_url(u: Column) -> Column:
    """Lower-case scheme and host, no tracking keys, sorted query, no fragment, at least / as the path."""
    kept = F.filter(pairs(query(u)), lambda p: ~F.lower(p["key"]).startswith("utm_") & ~F.lower(p["key"]).isin(*TRACKING))
    p = path(u)
    base = F.concat(scheme(u), F.lit("://"), netloc(u), F.when(p == "", "/").otherwise(p))
    return _with_query(base, _joined(F.array_sort(kept), "+"))


def detail_key(u: Column) -> Column:
    """The canonical URL without slashes at its end."""
    return F.regexp_replace(canonical_url(u), "/+$", "")


def canonical_page_url(u: Column) -> Column:
    """As canonical_url, with all keys, and runs of slashes made one."""
    p = F.regexp_replace(F.when(path(u) == "", "/").otherwise(path(u)), "/{2,}", "/")
    return _with_query(F.concat(scheme(u), F.lit("://"), netloc(u), p), _joined(F.array_sort(pairs(query(u))), "%20"))


def origin(u: Column) -> Column:
    """scheme://host[:port] without default ports; null with user information or another scheme."""

    def made(g: Column) -> Column:
        s, n, h, port = g["s"], g["n"], g["h"], g["port"]
        plain = (port == "") | ((s == "https") & (port == "443")) | ((s == "http") & (port == "80"))
        return F.when(s.isin("http", "https") & (h != "") & ~n.contains("@"), F.concat(s, F.lit("://"), h, F.when(plain, "").otherwise(F.concat(F.lit(":"), port))))

    parts = lambda g: F.struct(g["s"].alias("s"), g["n"].alias("n"), _host(g["n"]).alias("h"), F.regexp_extract(g["n"], r":(\d+)$", 1).alias("port"))
    return _let(_let(F.struct(scheme(u).alias("s"), netloc(u).alias("n")), parts), made)


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (netloc(a) == netloc(b))


def public_url(u: Column) -> Column:
    """The syntactic part of a public-URL gate: http(s), a host with a dot, no user information, a usual port."""
    port = F.regexp_extract(netloc(u), r":(\d+)$", 1)
    return scheme(u).isin("http", "https") & host(u).contains(".") & ~netloc(u).contains("@") & port.isin("", "80", "443")


def template_marker(c: Column) -> Column:
    """Template braces, plain or encoded up to three times."""

    def told(x: Column, times: int) -> Column:
        again = _let(decode(F.replace(x, F.lit("+"), F.lit("%2B"))), lambda y: told(y, times - 1)) if times else F.lit(False)
        return x.rlike(TEMPLATE) | F.coalesce(again, F.lit(False)) if times else x.rlike(TEMPLATE)

    # only an escape makes a second reading differ
    return _let(c, lambda x: F.coalesce(F.when(x.contains("%"), told(x, 3)).otherwise(x.rlike(TEMPLATE)), F.lit(False)))


def page_number(u: Column) -> Column:
    """The number of a generic page key or of /page/N, /page-N in the path."""
    keyed = F.get(F.filter(pairs(query(u)), lambda p: F.lower(p["key"]).isin(*GENERIC_PAGE_KEYS) & p["value"].rlike(r"^\d+$")), F.lit(0))["value"].try_cast("bigint")
    in_path = F.regexp_extract(path(u), r"(?i)(?:/|[-_])page[-_/]?(\d+)(?:/|$)", 1).try_cast("bigint")
    return F.coalesce(keyed, in_path)


def vehicle_page_number(u: Column) -> Column:
    """The one-based number of page state, in the query or as /pg/N, /page/N: any that a long holds."""
    return _vehicle_number(path(u), pairs(query(u)))


def _vehicle_number(p: Column, found: Column) -> Column:
    """As vehicle_page_number, of a path and the pairs of a query."""
    ok = lambda n: _let(n, lambda x: F.when(x >= 1, x))
    keyed = _let(F.filter(found, lambda x: F.lower(x["key"]).isin(*ONE_BASED)), lambda own: F.when(F.size(own) == 1, F.trim(F.get(own, F.lit(0))["value"]).try_cast("bigint")))
    return F.coalesce(ok(keyed), ok(F.regexp_extract(p, r"(?i)/(?:pg|page)/(\d+)(?=/|$)", 1).try_cast("bigint")))


def offset_state(u: Column) -> Column:
    """(key, offset) of the only row-offset key, else null."""
    return _offset(pairs(query(u)))


def _offset(found: Column) -> Column:
    """As offset_state, of the pairs of a query."""
    own = F.transform(F.filter(found, lambda p: F.lower(p["key"]).isin(*OFFSETS)), lambda p: F.struct(F.lower(p["key"]).alias("key"), F.trim(p["value"]).try_cast("bigint").alias("offset")))
    return _let(own, lambda x: F.when((F.size(x) == 1) & (F.get(x, F.lit(0))["offset"] >= 0), F.get(x, F.lit(0))))


def series_shape(u: Column) -> Column:
    """Path and query without page state: what the members of one pager share."""
    return _shape(path(u), pairs(query(u)))


def _shape(p: Column, found: Column) -> Column:
    """As series_shape, of a path and the pairs of a query."""
    bare = F.regexp_replace(F.regexp_replace(p, r"(?i)/(?:pg|page)/(\d+)(?=/|$)", "/"), "/+$", "")
    rest = F.filter(found, lambda x: ~F.lower(x["key"]).isin(*PAGE_KEYS))
    return F.concat(_let(bare, lambda x: F.when(x == "", "/").otherwise(x)), F.lit("?"), _joined(rest, "+"))


def collapse_page_keys(u: Column) -> Column:
    """The last value of each page key; a one-based key that says 1 goes."""

    def kept(found: Column) -> Column:
        return _let(F.transform(found, lambda x: F.lower(x["key"])), lambda keys: F.filter(
            found,
            lambda p, i: ~(F.get(keys, i).isin(*PAGE_KEYS) & F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), F.get(keys, i)))
            & ~(F.get(keys, i).isin(*ONE_BASED) & (F.trim(p["value"]) == "1")),
        ))

    made = lambda x: _with_query(F.concat(scheme(x), F.lit("://"), netloc(x), path(x)), _joined(_let(pairs(query(x)), kept), "+"))
    return _let(u, made)


def normalize_detail_url(u: Column) -> Column:
    """Identity of a detail page: host without www, path without a slash at its end, meaningful query, routing fragment."""
    n = F.regexp_extract(netloc(u), r":(\d+)$", 1)
    port = F.when(n.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), n))
    p = F.regexp_replace(F.regexp_replace(path(u), "/{2,}", "/"), "/+$", "")
    kept = F.array_sort(F.filter(F.transform(pairs(query(u)), lambda x: F.struct(x["key"].alias("key"), F.trim(x["value"]).alias("value"))), lambda x: ~x["key"].rlike(NOISE_QUERY) & (x["value"] != "")))
    f = F.when(fragment(u).rlike("[/=]"), F.concat(F.lit("#"), fragment(u))).otherwise("")
    tail = F.concat(_with_query(p, F.array_join(F.transform(kept, lambda x: F.concat(x["key"], F.lit("="), x["value"])), "&")), f)
    ok = scheme(u).isin("http", "https") & (host(u) != "") & ~template_marker(u)
    return F.when(ok, _let(tail, lambda t: F.when(t != "", F.concat(F.regexp_replace(host(u), r"^www\.", ""), port, t))))


def card_scope_key(u: Column) -> Column:
    """As normalize_detail_url, without query pairs whose value of 8 characters or more stands in the path."""

    def scoped(n: Column) -> Column:
        head = F.regexp_extract(n, r"^([^?]*)", 1)
        kept = F.filter(F.split(F.regexp_extract(n, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~((F.length(decode(_part(x, "=(.*)$"))) >= 8) & F.lower(head).contains(F.lower(decode(_part(x, "=(.*)$"))))))
        return _with_query(head, F.array_join(kept, "&"))

    return _let(normalize_detail_url(u), scoped)


def special_or_filter(u: Column) -> Column:
    return _special(path(u), pairs(query(u)))


def _special(p: Column, found: Column) -> Column:
    """As special_or_filter, of a path and the pairs of a query."""
    return p.rlike(SPECIAL_PATH) | F.exists(found, lambda x: x["key"].rlike(FILTER_QUERY))


def action_url(u: Column) -> Column:
    return u.rlike(ACTION_QUERY) | path(u).rlike(ACTION_PATH)


def route_tail(u: Column) -> Column:
    """The last part of the path, decoded, without a page's file extension."""
    return F.regexp_replace(decode(F.regexp_extract(F.regexp_replace(path(u), "/+$", ""), r"([^/]*)$", 1)), r"(?i)\.(?:s?html?|aspx?|php)$", "")


def detail_authority(u: Column, local_evidence: Column, stock_keys: Column, url_vin: Column) -> Column:
    """What makes a URL a vehicle's own page: url_vin, detail_route, vehicle_slug(_id), vehicle_hierarchy, vehicle_stock_path or null."""
    parts = lambda x: F.struct(F.regexp_replace(path(x), "/+$", "").alias("p"), route_tail(x).alias("tail"), url_vin.isNotNull().alias("has_vin"), special_or_filter(x).alias("special"), F.coalesce(local_evidence, F.lit(False)).alias("local"))
    # a filter that is moved below a projection takes the URL's own expression with it, to each place that names it
    return _let(u, lambda x: _let(parts(x), lambda g: _authority(x, g["p"], g["tail"], g["has_vin"], g["special"], g["local"], stock_keys)))


def _authority(u: Column, p: Column, tail: Column, has_vin: Column, special: Column, local: Column, stock_keys: Column) -> Column:
    parts = F.filter(F.transform(F.split(p, "/"), decode), lambda x: x != "")
    slug = lambda t: t.rlike(r"(?<!\d)(?:19|20)\d{2}(?!\d)") & (F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]{2,}"), 0)) >= 2) & (F.length(F.regexp_replace(t, "[^_-]", "")) >= 2)
    before = F.regexp_replace(F.get(parts, F.size(parts) - 2), r"(?i)\.(?:s?html?|aspx?|php)$", "")
    inner = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    last = F.get(parts, F.size(parts) - 1)
    hierarchy = (
        F.size(parts).between(4, 8)
        & (F.lower(F.get(parts, F.lit(0))) == "vehicles")
        & F.get(parts, F.lit(1)).rlike(r"^(?:19|20)\d{2}$")
        & F.forall(inner, lambda x: x.rlike(r"^[A-Za-z0-9_-]{1,64}$"))
        & last.rlike(r"^[A-Za-z0-9]{5,16}$")
        & last.rlike(r"\d")
        & F.exists(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), lambda x: x.rlike("[A-Za-z]{2,}"))
    )
    listing = F.lower(F.regexp_extract(p, "([^/]*)$", 1)).isin("inventory", "vehicles", "new", "used", "certified", "search", "results")
    plausible = ~template_marker(u) & (has_vin | (~special & ~listing)) & (p != "")
    closed = special | p.rlike(CATEGORY_PATH) | tail.rlike(LISTING_TAIL)
    return F.when(
        plausible & ~action_url(u),
        F.when(has_vin, "url_vin")
        .when(closed, None)
        .when(p.rlike(DETAIL_ROUTE), "detail_route")
        .when(local & slug(tail), "vehicle_slug")
        .when(local & (F.size(parts) >= 2) & tail.rlike(r"^\d{5,16}$") & slug(before), "vehicle_slug_id")
        .when(local & hierarchy, "vehicle_hierarchy")
        .when(local & F.size(parts).between(2, 8) & F.coalesce(F.array_contains(stock_keys, F.lower(tail)), F.lit(False)), "vehicle_stock_path"),
    )


@F.pandas_udf(StringType())
def urljoin(base: pd.Series, ref: pd.Series) -> pd.Series:
    """RFC 3986 resolution; null for references that cannot be resolved."""

    def one(b: str | None, r: str | None) -> str | None:
        try:
            return None if r is None else _join(b or "", r.strip())
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref)], dtype="object")
