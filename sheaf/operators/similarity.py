"""Platform fingerprints of pages, weighted similarity search over them, and reconciliation of two extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U

#: Weights of shared features, weak values, verdict weights, floor and number of matches.
WEIGHTS = {"platform_tokens": 4.0, "gallery_mechanisms": 3.0, "photo_cdn_hosts": 2.5, "photo_path_grammars": 2.0, "pagination": 1.5, "class_families": 1.0, "json_ld_types": 0.5}
WEAK = ("widget:slick", "platform:wordpress", "lib:lozad", "gallery:background-image", "gallery:srcset", "gallery:data-src-lazy")
WEAK_WEIGHT = 1.0
VERDICTS = {"verified": 1.0, "ship": 1.0, "review": 0.95, "needs_repair": 0.8, "fingerprint_only": 0.6}
FLOOR, MATCHES = 10.0, 2
#: Patterns of platforms and galleries in markup.
PLATFORMS = {
    "platform:dealer.com": r"pictures\.dealer\.com|static\.dealer\.com|\bDDC\.WS\b|\bddc-content\b|dealerdotcom",
    "widget:ws-inv": r"\bws-inv[a-z0-9-]*",
    "widget:ws-vehicle": r"\bws-vehicle[a-z0-9-]*",
    "widget:ws-media": r"\bws-media[a-z0-9-]*|\bmedia1\b",
    "platform:dealercenter": r"imagescf\.dealercenter\.net|dealercenter",
    "widget:dws": r"\bdws-[a-z0-9-]+",
    "platform:dealerinspire": r"dealerinspire|\bdi-widget\b",
    "gallery:unitegallery": r"unitegallery|\bug-gallery\b|\bug-item\b|\bug-thumb",
    "widget:slick": r"\bslick-slider\b|\bslick-track\b",
    "lib:lozad": r"\blozad\b",
    "widget:vehicle-card": r"\bvehicle-card[a-z0-9-]*",
    "platform:carscommerce": r"carscommerce",
    "platform:homenet": r"homenetiol",
    "platform:dealeron": r"dealeron",
    "platform:dealervenom": r"dealervenom|instantsearch",
    "widget:srp-vehicle-box": r"\bsrp-vehicle-box\b",
    "platform:wordpress": r"/wp-content/",
    "platform:sm360": r"\bsm360\b",
    "platform:edealer": r"\bedealer\b",
    "platform:teamvelocity": r"teamvelocity|apollo-sitemap",
    "platform:waynereaves": r"waynereaves|/service/picture/",
}
GALLERIES = {
    "gallery:data-pin-media": "data-pin-media",
    "gallery:data-base-img-url": "data-base-img-url",
    "gallery:data-full": "data-full",
    "gallery:data-background-image": "data-background-image",
    "gallery:background-image": "background-image:",
    "gallery:srcset": "srcset=",
    "gallery:data-src-lazy": "data-src=",
}
#: Patterns of photo paths in markup, in their own case.
GRAMMARS = {
    "grammar:/service/picture/": r"/service/picture/",
    "grammar:resize-WxH-segment": r"(?i)/(?:resize/)?\d{1,5}x\d{1,5}(?=/)",
    "grammar:impolicy-query": r"impolicy=",
    "grammar:dealercenter-numeric-pair": r"imagescf\.dealercenter\.net",
    "grammar:homenet-media": r"getauto\.photos|content\.homenetiol\.com",
}
#: Class prefixes that say nothing; the least count and the number of class families.
PLAIN_CLASSES = (
    "col row btn nav bg text border flex grid justify items font is has no not px py mx my mt mb ml mr pt pb pl pr sm md lg xl xs fa icon active hidden "
    "visible container wrapper wrap inner outer content main page site header footer menu link list item button input form field label img image video "
    "d w h m p t b l r u v js wp align elementor vc wpb order self gap hover focus block inline relative absolute fixed static top bottom left right "
    "center start end full min max width height position display overflow"
).split()
FAMILY_COUNT, FAMILIES, HOSTS = 8, 12, 8


def _named(rules: dict[str, str], html: Column, regex: bool, flags: str = "(?i)") -> Column:
    """Names of the rules that hold, sorted."""
    return F.array_sort(F.filter(F.array(*(F.when(html.rlike(flags + p) if regex else F.lower(html).contains(p), F.lit(n)) for n, p in rules.items())), lambda x: x.isNotNull()))


def class_tokens(html: Column) -> Column:
    """Lower-case class names of a page, repetitions kept."""
    values = F.regexp_extract_all(html, F.lit(r"(?i)class\s*=\s*[\"']([^\"']{1,400})[\"']"), 1)
    return F.filter(F.flatten(F.transform(values, lambda v: F.split(F.lower(v), r"\s+"))), lambda t: t != "")


def features(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, feature, value) of all pages: their markup is read once, and what is counted is counted after one explode."""
    page = F.col(html)
    named = lambda feature, values: F.transform(values, lambda v: F.struct(F.lit(feature).alias("feature"), v.alias("value")))
    family = F.filter(F.transform(F.filter(class_tokens(page), lambda t: F.length(t).between(3, 60) & t.contains("-")), lambda t: F.split_part(t, F.lit("-"), F.lit(1))), lambda f: (F.length(f) >= 3) & ~f.isin(*PLAIN_CLASSES) & f.rlike(r"^\p{L}+$"))
    images = F.regexp_extract_all(page, F.lit(r"(?i)(https?://[^\s\"'<>\\)]{4,500}\.(?:jpe?g|png|webp|avif|gif))"), 1)
    hosts = F.filter(F.transform(images, lambda u: U.host(u)), lambda h: h != "")
    scripts = F.regexp_extract_all(page, F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    types = F.array_distinct(F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(r"\"@type\"\s*:\s*\"([^\"]+)\""), 1))))
    paging = {"pager:rel-next": r"rel\s*=\s*[\"']?next\b", "pager:query": r"href\s*=\s*[\"'][^\"']*[?&](?:page|pg)=\d", "pager:offset": r"href\s*=\s*[\"'][^\"']*[?&](?:start|offset)=\d", "pager:path": r"href\s*=\s*[\"'][^\"']*/(?:page|pg)/\d"}
    found = F.concat(
        named("platform_tokens", _named(PLATFORMS, page, True)),
        named("gallery_mechanisms", _named(GALLERIES, page, False)),
        named("photo_path_grammars", _named(GRAMMARS, page, True, "")),
        named("pagination", _named(paging, page, True)),
        named("json_ld_types", types),
        named("class_families", family),
        named("photo_cdn_hosts", hosts),
    )
    counted = pages.select(key, F.explode(found).alias("f")).groupBy(key, F.col("f.feature").alias("feature"), F.col("f.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    enough = counted.where((F.col("feature") != "class_families") | (F.col("n") >= FAMILY_COUNT))
    most = F.when(F.col("feature") == "class_families", FAMILIES).when(F.col("feature") == "photo_cdn_hosts", HOSTS)
    rank = F.row_number().over(Window.partitionBy(key, "feature").orderBy(F.desc("n"), "value"))
    shown = F.when(F.col("feature") == "class_families", F.concat(F.lit("family:"), "value", F.lit("-"))).when(F.col("feature") == "photo_cdn_hosts", F.concat(F.lit("cdn:"), "value")).otherwise(F.col("value"))
    return enough.withColumn("r", rank).where(most.isNull() | (F.col("r") <= most)).select(key, "feature", shown.alias("value"))


def weight(feature: Column, value: Column) -> Column:
    w = F.coalesce(*(F.when(feature == k, F.lit(v)) for k, v in WEIGHTS.items()), F.lit(0.0))
    return F.when(value.isin(*WEAK), F.lit(WEAK_WEIGHT)).otherwise(w)


def _pairs(q: DataFrame, own: DataFrame) -> DataFrame:
    """(query, origin, overlap, verdict) of records that share strong features; weak values add to the pairs found."""
    strong = ~F.col("value").isin(*WEAK)
    # weak values of a record: no more than there are
    weak = lambda df, name, to: df.where(~strong).groupBy(name).agg(F.collect_set(F.concat_ws("|", "feature", "value")).alias(to))
    shared = q.where(strong).join(own.where(strong), ["feature", "value"]).where(F.col("qh").isNull() | (F.col("qh") != F.col("host")))
    pairs = shared.groupBy("query", "origin").agg(F.sum(weight(F.col("feature"), F.col("value"))).alias("strong"), F.min("verdict").alias("verdict"))
    both = pairs.join(weak(q, "query", "qw"), "query", "left").join(weak(own, "origin", "ow"), "origin", "left")
    return both.select("query", "origin", F.round(F.col("strong") + WEAK_WEIGHT * F.coalesce(F.size(F.array_intersect("qw", "ow")), F.lit(0)), 3).alias("overlap"), "verdict")


def _scored(pairs: DataFrame, floor: float) -> DataFrame:
    by = F.coalesce(*(F.when(F.col("verdict") == v, F.lit(w)) for v, w in VERDICTS.items()), F.lit(0.6))
    return pairs.withColumn("score", F.round(F.col("overlap") * by, 2)).where(F.col("score") >= floor).drop("verdict")


def _best(rows: DataFrame, by: str, k: int, order: list[Column]) -> DataFrame:
    """Rows that may be among the k best of a group once those of any one host are left out.

    Those lie in the k + 2 hosts whose best rows come first: one is the host left out, one may be no host at all.
    """
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(by, "host").orderBy(*order))).where(F.col("__n") <= k)
    first = ranked.where("__n = 1").select(by, "host", F.row_number().over(Window.partitionBy(by).orderBy(*order)).alias("__h")).where(F.col("__h") <= k + 2)
    return ranked.join(first.select(F.col(by).alias("__b"), F.col("host").alias("__host")), (F.col(by) == F.col("__b")) & F.col("host").eqNullSafe(F.col("__host")), "left_semi").drop("__n")


def similar(queries: DataFrame, library: DataFrame, floor: float = FLOOR, k: int = MATCHES) -> DataFrame:
    """The k best library records of each query: (query, origin, overlap, score, rank).

    queries: (query, host, feature, value); library: (origin, host, verdict, feature, value). Both sides meet on strong
    features alone; weak values, which most pages have, are a short list of each record and add to the pairs found.
    They cannot reach the floor by themselves, so no pair is lost; a lower floor is refused.

    Equal records are compared once: queries of one set of features are one profile, library records of one set of
    features and verdict one class, which shows the few members that can be among the k best for any host. Records that
    have several hosts are compared one by one.
    """
    if floor <= len(WEAK) * WEAK_WEIGHT * max(VERDICTS.values()):
        raise ValueError("weak values alone could reach this floor")
    q = queries.select("query", F.col("host").alias("qh"), "feature", "value")
    own = library.select("origin", "host", "verdict", "feature", "value")
    digest = lambda c: F.sha2(F.to_json(F.struct(c.alias("c")), {"ignoreNullFields": "false"}), 256)
    single = F.size("hosts") < 2
    shown = lambda hosts: F.get(hosts, F.lit(0))["h"]

    asked = q.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("feature", "value"))).alias("cells"), F.collect_set(F.struct(F.col("qh").alias("h"))).alias("hosts")).withColumn("profile", digest(F.col("cells")))
    known = own.groupBy("origin").agg(F.array_sort(F.collect_set(F.struct("verdict", "feature", "value"))).alias("cells"), F.collect_set(F.struct(F.col("host").alias("h"))).alias("hosts")).withColumn("class", digest(F.col("cells")))
    profiles = asked.where(single).groupBy("profile").agg(F.first("cells").alias("cells")).select(F.col("profile").alias("query"), F.lit(None).cast("string").alias("qh"), F.explode("cells").alias("c")).select("query", "qh", "c.*")
    classes = known.where(single).groupBy("class").agg(F.first("cells").alias("cells")).select(F.col("class").alias("origin"), F.lit(None).cast("string").alias("host"), F.explode("cells").alias("c")).select("origin", "host", "c.*")
    members = _best(known.where(single).select("class", shown(F.col("hosts")).alias("host"), "origin"), "class", k, [F.col("origin").asc()])
    # the profile has a shape's scores, its members are few
    met = _scored(_pairs(profiles, classes), floor).select(F.col("query").alias("profile"), F.col("origin").alias("class"), "overlap", "score")
    order = [F.desc("score"), F.col("origin").asc()]
    few = _best(met.join(members, "class").drop("class"), "profile", k, order)
    theirs = asked.where(single).select("query", shown(F.col("hosts")).alias("qh"), "profile")
    found = theirs.join(few, "profile").where(F.col("qh").isNull() | (F.col("qh") != F.col("host"))).select("query", "origin", "overlap", "score")
    # records of several hosts on either side, each against all
    odd_q, odd_own = q.distinct().join(asked.where(~single).select("query"), "query", "left_semi"), own.distinct().join(known.where(~single).select("origin"), "origin", "left_semi")
    even_q = q.distinct().join(asked.where(~single).select("query"), "query", "left_anti")
    odd = _scored(_pairs(odd_q, own.distinct()).unionByName(_pairs(even_q, odd_own)), floor).select("query", "origin", "overlap", "score")
    return found.unionByName(odd).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def reconcile(left: DataFrame, right: DataFrame, key: str, texts: list[str], numbers: list[str], least: int = 5) -> DataFrame:
    """(field, matches, agree, dropped): how far two extractions of the same records agree, by field.

    A field is dropped where at least least records have it on both sides and fewer than half of them agree.
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("field"), T.comparable(F.col(c), c in numbers).alias(name)) for c in [*texts, *numbers]]
        return df.select(F.upper(F.col(key).cast("string")).alias("k"), F.explode(F.array(*cells)).alias("c")).select("k", "c.*").where(F.col(name).isNotNull())

    both = long(left, "a").join(long(right, "b"), ["k", "field"])
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("a") == F.col("b")).alias("agree")).withColumn("dropped", (F.col("matches") >= least) & (F.col("agree") * 2 < F.col("matches")))
