"""Operators on ordered crawl rows: identity, keep-first dedupe, page loops, next pages and the listing-detail join.

"First" always means the smallest (page_no, item_no); no operator relies on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions import vin as V

#: Identity columns by priority, URL columns, and the columns that name a row.
IDENTITY = ("vin", "sku", "listing_id", "stock_number", "doi")
URLS = ("apply_url", "url")
PRIMARY = ("title", "headline", "name", "quote", "item", "property", "instrument")
#: Labels and attribute words of next-page links.
NEXT_LABELS = ("next", "next page", "more", "more results", "older", "older posts", "›", "»", "→")
NEXT_SEMANTICS = ("next", "pagination", "paginator", "pager")


def _kind(df: DataFrame, c: str) -> str:
    k = dict(df.dtypes)[c]
    return k if k == "string" or k.startswith("array") else "other"


def row_fingerprint(df: DataFrame) -> Column:
    """A hash that is equal for rows of one identity: key column, else URL and title, else all columns but _ ones."""
    cases: Column | None = None
    key = lambda *parts: F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts))), 256)

    def add(cases: Column | None, test: Column, value: Column) -> Column:
        return F.when(test, value) if cases is None else cases.when(test, value)

    for c in IDENTITY:
        if c in df.columns:
            cases = add(cases, ~T.is_blank(F.col(c), _kind(df, c)), key(F.lit(c), F.lit(dict(df.dtypes)[c]), F.col(c)))
    names = [F.when(~T.is_blank(F.col(c), _kind(df, c)), F.col(c).cast("string")) for c in PRIMARY if c in df.columns]
    primary = F.coalesce(*names) if names else F.lit(None).cast("string")
    for c in URLS:
        if c in df.columns:
            cases = add(cases, ~T.is_blank(F.col(c)), key(F.lit(c), U.canonical_url(F.col(c)), primary))
    rest = sorted(c for c in df.columns if not c.startswith("_"))
    whole = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    return whole if cases is None else cases.otherwise(whole)


def keep_first(df: DataFrame, by: Iterable[str | Column], order: Iterable[str], scope: Iterable[str] = ()) -> DataFrame:
    """The first row of each key, by aggregation: no key is collected into one task's window."""
    columns = df.columns
    keys = [F.col(k) if isinstance(k, str) else k for k in by]
    marked = df.select(*columns, *(k.alias(f"__k{i}") for i, k in enumerate(keys)))
    groups = [*scope, *(f"__k{i}" for i in range(len(keys)))]
    first = marked.groupBy(*groups).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return first.select("row.*")


def page_fingerprints(rows: DataFrame, page: Iterable[str], fingerprint: str = "fp") -> DataFrame:
    """A hash of each page's sorted row fingerprints."""
    return rows.groupBy(*page).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(fingerprint)), "\n"), 256).alias("page_fp"))


def page_loop(rows: DataFrame, pages: DataFrame, max_items: int, max_pages: int, byte_cap: int = 64_000_000, scope: str = "source_id") -> DataFrame:
    """Where each crawl stops: (scope, stop_page, stop_reason, pages_read, new_rows).

    pages has (scope, page_no, url, bytes, has_next); rows (scope, page_no, item_no, fp). A crawl stops at the first page
    whose URL or content was seen, that adds no row, that reaches max_items or the byte cap, or that has no next page.
    """
    firsts = rows.groupBy(scope, "fp").agg(F.min(F.struct("page_no", "item_no")).alias("at"))
    new = firsts.groupBy(scope, F.col("at.page_no").alias("page_no")).agg(F.count(F.lit(1)).alias("new_rows"))
    content = page_fingerprints(rows, [scope, "page_no"])
    by_page = Window.partitionBy(scope).orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    seen_url = Window.partitionBy(scope, "page_key").orderBy("page_no")
    seen_fp = Window.partitionBy(scope, "page_fp").orderBy("page_no")
    state = (
        pages.withColumn("page_key", U.canonical_url(F.col("url")))
        .join(content, [scope, "page_no"], "left")
        .join(new, [scope, "page_no"], "left")
        .withColumn("page_fp", F.coalesce("page_fp", F.sha2(F.lit(""), 256)))
        .withColumn("new_rows", F.coalesce("new_rows", F.lit(0)))
        .withColumn("url_again", F.row_number().over(seen_url) > 1)
        .withColumn("content_again", F.row_number().over(seen_fp) > 1)
        .withColumn("total_rows", F.sum("new_rows").over(by_page))
        .withColumn("total_bytes", F.sum("bytes").over(by_page))
        .withColumn("nth", F.row_number().over(Window.partitionBy(scope).orderBy("page_no")))
    )
    reason = (
        F.when(F.col("url_again"), "repeated_page_url")
        .when(F.col("content_again"), "duplicate_page")
        .when((F.col("total_rows") >= max_items) & F.col("has_next"), "max_items")
        .when(F.col("total_rows") >= max_items, "no_next_link")
        .when(F.col("new_rows") == 0, "no_new_rows")
        .when(F.col("total_bytes") >= byte_cap, "byte_safety_cap")
        .when(~F.col("has_next"), "no_next_link")
        .when(F.col("nth") >= max_pages, "max_pages")
    )
    return (
        state.withColumn("reason", reason)
        .groupBy(scope)
        .agg(
            F.min(F.when(F.col("reason").isNotNull(), F.struct("page_no", "reason", "nth", F.least("total_rows", F.lit(max_items)).alias("rows")))).alias("stop"),
            F.max(F.struct("page_no", F.lit("end_of_capture").alias("reason"), "nth", F.least("total_rows", F.lit(max_items)).alias("rows"))).alias("end"),
        )
        .withColumn("s", F.coalesce("stop", "end"))
        .select(scope, F.col("s.page_no").alias("stop_page"), F.col("s.reason").alias("stop_reason"), F.col("s.nth").alias("pages_read"), F.col("s.rows").alias("new_rows"))
    )


def crawl_rows(rows: DataFrame, stops: DataFrame, max_items: int, scope: str = "source_id") -> DataFrame:
    """The first of each identity on the pages that were read, max_items at most for each crawl."""
    read = rows.join(stops.select(scope, "stop_page", "stop_reason"), scope).where(
        (F.col("page_no") < F.col("stop_page")) | ((F.col("page_no") == F.col("stop_page")) & ~F.col("stop_reason").isin("repeated_page_url", "duplicate_page"))
    )
    kept = keep_first(read.drop("stop_page", "stop_reason"), ["fp"], ["page_no", "item_no"], [scope])
    nth = F.row_number().over(Window.partitionBy(scope).orderBy("page_no", "item_no"))
    return kept.withColumn("nth", nth).where(F.col("nth") <= max_items).drop("nth")


def next_pages(links: DataFrame, url: str = "url", by: Iterable[str] = ("url",)) -> DataFrame:
    """The next page of each page from its links (see html.links): target, score and selector of the best one."""
    current = F.coalesce(U.page_number(F.col(url)), F.lit(1))
    number = U.page_number(F.col("target"))
    label = F.lower(F.col("text"))
    rel_next = F.array_contains(F.split("rel", " "), "next")
    named = label.isin(*NEXT_LABELS) | label.startswith("next page") | label.startswith("next results")
    means = F.lit(False)
    for w in NEXT_SEMANTICS:
        means = means | F.col("semantics").contains(w)
    keyed = lambda u: F.when(U.query(u).rlike(r"(?i)(?:^|&)(?:page|p|pg|page_num|pagenumber)=\d+(?:&|$)"), F.lower(F.regexp_extract(U.query(u), r"(?i)(?:^|&)(page|p|pg|page_num|pagenumber)=\d+", 1)))
    same_key = keyed(F.col(url)).isNull() & U.page_number(F.col(url)).isNull() | (F.coalesce(keyed(F.col(url)), F.lit("path")) == F.coalesce(keyed(F.col("target")), F.lit("path"))) | F.col("semantics").contains("pag")
    score = (
        F.when(rel_next, 220).otherwise(0)
        + F.when(named, 110).otherwise(0)
        + F.when(means, 75).otherwise(0)
        + F.when((number == current + 1) & same_key, 70).when(number <= current, -90).otherwise(0)
    )
    usable = (
        (F.col("disabled") == 0)
        & (F.col("href") != "")
        & ~F.col("href").rlike("^(?:#|javascript:|mailto:|tel:)")
        & U.scheme(F.col("target")).isin("http", "https")
        & ~U.netloc(F.col("target")).contains("@")
        & U.same_origin(F.col("target"), F.col(url))
        & (U.canonical_url(F.col("target")) != U.canonical_url(F.col(url)))
        & ((F.col("tag") == "a") | rel_next)
    )
    scored = links.where(usable).withColumn("score", score).where("score >= 70")
    best = scored.groupBy(*by).agg(F.max(F.struct("score", (-F.col("link_no")).alias("first"), "target", "selector")).alias("b"))
    return best.select(*by, F.col("b.target").alias("next_url"), F.col("b.score").alias("score"), F.col("b.selector").alias("selector"))


def next_in_series(links: DataFrame, url: str = "url", by: Iterable[str] = ("url",)) -> DataFrame:
    """The smallest number above the current one of a pager that publishes two numbers at least."""
    given = links.withColumn("t", U.collapse_page_keys(F.col("target"))).withColumn("n", U.vehicle_page_number(F.col("t")))
    shaped = given.where("n is not null").where(~U.special_or_filter(F.col("t")) & U.path(F.col("t")).rlike(U.INVENTORY_PATH) & (U.origin(F.col("t")) == U.origin(F.col(url))))
    series = shaped.groupBy(*by, U.origin(F.col("t")).alias("o"), U.series_shape(F.col("t")).alias("s")).agg(
        F.count_distinct("n").alias("members"),
        F.min(F.when(F.col("n") > F.coalesce(U.vehicle_page_number(F.col(url)), F.lit(1)), F.struct("n", "t"))).alias("b"),
    )
    return series.where("members >= 2 and b is not null").groupBy(*by).agg(F.min("b").alias("b")).select(*by, F.col("b.t").alias("next_url"), F.col("b.n").alias("page_number"))


def next_by_offset(links: DataFrame, url: str = "url", by: Iterable[str] = ("url",)) -> DataFrame:
    """One step of a row-offset pager; the step is its smallest gap, and only a published link is followed."""
    keys = list(by)
    given = links.withColumn("t", U.collapse_page_keys(F.col("target"))).withColumn("state", U.offset_state(F.col("t")))
    now = U.offset_state(F.col(url))
    usable = given.where("state is not null").where(
        ~U.special_or_filter(F.col("t")) & U.path(F.col("t")).rlike(U.INVENTORY_PATH) & (U.origin(F.col("t")) == U.origin(F.col(url))) & F.coalesce(F.col("state.key") == now["key"], F.lit(True))
    )
    members = usable.groupBy(*keys, U.origin(F.col("t")).alias("o"), U.series_shape(F.col("t")).alias("s"), F.col("state.offset").alias("offset")).agg(F.min_by("t", "link_no").alias("t"), F.first(F.coalesce(now["offset"], F.lit(0))).alias("at"))
    ordered = Window.partitionBy(*keys, "o", "s").orderBy("offset")
    steps = members.withColumn("gap", F.lead("offset").over(ordered) - F.col("offset"))
    step = F.min("gap").over(Window.partitionBy(*keys, "o", "s"))
    found = steps.withColumn("step", step).where("step > 0 and offset = at + step")
    return found.groupBy(*keys).agg(F.min(F.struct("offset", "t")).alias("b")).select(*keys, F.col("b.t").alias("next_url"), F.col("b.offset").alias("offset"))


def join_details(listing: DataFrame, details: DataFrame, fields: Iterable[str], url: str = "url", detail_url: str = "url", append_slash: bool = False) -> DataFrame:
    """Listing rows, blank fields filled from the first detail page of the same key; listing values win."""
    slash = lambda u: F.when(F.lit(append_slash) & ~u.endswith("/"), F.concat(u, F.lit("/"))).otherwise(u)
    wanted = list(fields)
    order = [c for c in ("page_no", "item_no") if c in details.columns] or wanted
    firsts = details.select(U.detail_key(F.col(detail_url)).alias("__key"), F.struct(*order).alias("__o"), F.struct(*wanted).alias("__d")).groupBy("__key").agg(F.min_by("__d", "__o").alias("__d"))
    joined = listing.withColumn("__key", U.detail_key(slash(F.col(url)))).join(firsts, "__key", "left")
    out = [T.coalesce_blank(F.col(c), F.col(f"__d.{c}"), _kind(listing, c)).alias(c) if c in wanted else F.col(c) for c in listing.columns]
    return joined.select(*out, *(F.col(f"__d.{c}").alias(c) for c in wanted if c not in listing.columns))


def fill_vehicle(listing: DataFrame, details: DataFrame, key: str = "detail_key") -> DataFrame:
    """Vehicle listing rows filled from proven detail rows of the same key.

    Detail lists replace, a withheld price stays withheld, a surrogate VIN gives way to a real one, and a proven
    gallery replaces the listing's photos.
    """
    d = details.select(F.col(key), F.struct(*(c for c in details.columns if c != key)).alias("d"))
    joined = listing.join(d, key, "left")
    has = set(details.columns)
    withheld = F.coalesce(F.col("price_exception") == "no_price_published", F.lit(False)) if "price_exception" in listing.columns else F.lit(False)
    out: list[Column] = []
    for c in listing.columns:
        own, other = F.col(c), F.col(f"d.{c}") if c in has else None
        if other is None or c == key:
            out.append(own)
        elif c == "price":
            out.append(F.when(~withheld & ~T.positive(own) & T.positive(other), other).otherwise(own).alias(c))
        elif c == "vin":
            real = V.clean_vin(other)
            out.append(F.when(V.is_surrogate(own) & real.isNotNull(), real).otherwise(T.coalesce_blank(own, other)).alias(c))
        elif c in ("photos", "features"):
            out.append(F.when(F.size(other) > 0, other).otherwise(own).alias(c))
        else:
            out.append(T.coalesce_blank(own, other, _kind(listing, c)).alias(c))
    return joined.select(*out)


def gallery_authority(rows: DataFrame, galleries: DataFrame, key: str = "detail_key") -> DataFrame:
    """Rows whose photos are those of their proven detail page, or none: a listing's picture never stands in for them.

    galleries: (key, photos, census, placeholder) of proven pages alone; census counts the page's own photos. A page
    with one photo of its own, and one that publishes a placeholder, say so; rows without a proven page stay.
    """
    g = galleries.select(key, F.struct(F.coalesce("photos", F.array().cast("array<string>")).alias("photos"), "census", "placeholder").alias("g"))
    joined = rows.join(g, key, "left")
    kept = F.col("photo_exception") if "photo_exception" in rows.columns else F.lit(None).cast("string")
    proven, n = F.col("g").isNotNull(), F.size("g.photos")
    said = F.when((n == 1) & (F.col("g.census") == 1), "single_photo_published").when((n == 0) & F.col("g.placeholder"), "no_photos_published").otherwise(kept)
    own = {"photos": F.col("g.photos"), "photo": F.get("g.photos", F.lit(0))}
    columns = [F.when(proven, own[c]).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in rows.columns if c != "photo_exception"]
    return joined.select(*columns, F.when(proven, said).otherwise(kept).alias("photo_exception"))


#: Fixed value: records of a crawl, which bounds what one fold may hold.
FOLD = 5000


def _linked(edges: DataFrame) -> DataFrame:
    """(b, label) of the nodes b that several others share an a with: the smallest that each reaches, by rounds of two numbers a node."""
    many = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = edges.join(many, "a", "left_semi").localCheckpoint()
    labels = links.select("b", F.col("b").alias("label")).distinct().localCheckpoint()
    while True:
        near = links.join(labels, "b").groupBy("a").agg(F.min("label").alias("m")).join(links, "a").groupBy("b").agg(F.min("m").alias("m"))
        jump = labels.select(F.col("b").alias("m"), F.col("label").alias("next"))
        lower = labels.join(near, "b").join(jump, "m", "left").select("b", F.col("label").alias("old"), F.least("m", F.coalesce("next", "m")).alias("label")).localCheckpoint()
        labels = lower.select("b", "label")
        if lower.where("old <> label").isEmpty():
            return labels


def dedupe_records(df: DataFrame, scope: str = "origin", order: Iterable[str] = ("page_no", "item_no")) -> DataFrame:
    """Records of each origin merged by detail key or real VIN, in order.

    A record that meets an earlier one fills its blanks, and a real VIN replaces a surrogate. Records that share neither
    key nor VIN with another one of their origin stay as they are. All others are folded in order, those that keys and
    VINs link, directly or by others, by themselves: no other record can change what they become, so an origin may have
    any number of them. FOLD linked records are a fold's most, the crawl's own cap; more are an error.
    """
    columns = df.columns
    schema = df.schema
    real = F.when(~V.is_surrogate(F.col("vin")), F.col("vin"))
    shared = lambda c: F.col(c).isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy(scope, c)) > 1)
    marked = df.withColumn("__v", F.when(real != "", real)).withColumn("__u", F.when(F.col("detail_key") != "", F.col("detail_key")))
    marked = marked.withColumn("__a", shared("__u")).withColumn("__b", shared("__v"))
    alone = marked.where(~F.col("__a") & ~F.col("__b")).select(*columns)
    # numbers stand for keys: two keys of one number would be folded together, which changes nothing
    node = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(scope, F.lit(c), c))
    meeting = marked.where(F.col("__a") | F.col("__b")).select(*columns, node("__u").alias("__a"), node("__v").alias("__b"))
    edges = meeting.where("__a is not null and __b is not null").select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct()
    first = edges.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("__f"))
    at = meeting.join(first, "__a", "left").withColumn("__b", F.coalesce("__b", "__f", "__a"))
    labelled = at.join(_linked(edges).withColumnRenamed("b", "__b"), "__b", "left").select(*columns, F.coalesce("label", "__b").alias("__c"))
    dealt = labelled.repartition(scope, "__c").sortWithinPartitions(scope, "__c", *(F.col(c).asc_nulls_last() for c in order))

    def fold(records: Iterable[dict]) -> list[dict]:
        by_url: dict[str, int] = {}
        by_vin: dict[str, int] = {}
        out: list[dict] = []
        blank = lambda v: v is None or (isinstance(v, float) and v != v) or (hasattr(v, "__len__") and len(v) == 0)
        for n, record in enumerate(records):
            if n >= FOLD:
                raise ValueError(f"more than {FOLD} records of one {scope} share keys; a crawl has {FOLD} at most")
            u, v = record.get("detail_key"), record.get("vin")
            real = v if v and not str(v).startswith(V.SURROGATE) else None
            found = [i for i in (by_url.get(u) if u else None, by_vin.get(real) if real else None) if i is not None]
            if found:
                i = min(found)
                for k, x in record.items():
                    if blank(out[i].get(k)) and not blank(x):
                        out[i][k] = x
                if real and str(out[i].get("vin") or "").startswith(V.SURROGATE):
                    out[i]["vin"] = real
            else:
                i = len(out)
                out.append(record)
            now = out[i].get("vin")
            if out[i].get("detail_key"):
                by_url[out[i]["detail_key"]] = i
            if now and not str(now).startswith(V.SURROGATE):
                by_vin[now] = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        kinds: list[pa.Schema] = []

        def records() -> Iterator[dict]:
            for batch in batches:
                kinds[:] = [pa.schema(list(batch.schema)[:-1])]
                for i in range(0, batch.num_rows, 1000):
                    yield from batch.slice(i, 1000).to_pylist()

        for _, linked in groupby(records(), lambda r: (r[scope], r["__c"])):
            made += fold({k: x for k, x in r.items() if k != "__c"} for r in linked)
            if len(made) >= 1000:
                yield pa.RecordBatch.from_pylist(made, kinds[0])
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, kinds[0])

    return alone.unionByName(dealt.mapInArrow(run, schema))


def conflicts(df: DataFrame, scope: str = "origin") -> DataFrame:
    """(scope, kind, key, values): detail keys with several real VINs, and VINs with several detail keys."""
    real = F.when(~V.is_surrogate(F.col("vin")) & (F.col("vin") != ""), F.col("vin"))
    r = df.select(scope, F.when(F.col("detail_key") != "", F.col("detail_key")).alias("u"), real.alias("v")).where("u is not null and v is not null")
    told = lambda kind, a, b: r.groupBy(scope, F.col(a).alias("key")).agg(F.array_sort(F.collect_set(b)).alias("values")).where(F.size("values") > 1).select(scope, F.lit(kind).alias("kind"), "key", "values")
    return told("detail_key", "u", "v").unionByName(told("vin", "v", "u"))


def latest(rows: DataFrame, fields: list[str], order: Iterable[str] = ("page_no", "item_no")) -> DataFrame:
    """The first row on the requested fields, and which of them it has."""
    first = rows.orderBy(*order).limit(1)
    have = [f for f in fields if f in rows.columns]
    kinds = {f: _kind(rows, f) for f in have}
    found = F.filter(F.array(*(F.when(~T.is_blank(F.col(f), kinds[f]), F.lit(f)) for f in have)), lambda x: x.isNotNull()) if have else F.array().cast("array<string>")
    return first.select(*have, found.alias("found"), F.array_except(F.array(*(F.lit(f) for f in fields)), found).alias("missing"))


def rows_page(rows: DataFrame, offset: int, limit: int, order: Iterable[str] = ("page_no", "item_no")) -> DataFrame:
    """A page of rows in order, 200 at most."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, 200))
