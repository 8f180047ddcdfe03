"""The cascade that decides a vehicle listing's next page: what kind of link is trusted first, and which steps are legal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

#: What a next page is named by, the most trusted first, and labels of next controls.
REASONS = ("selector", "series", "rel_next", "label", "number", "offset")
LABEL = r"(?i)^(?:next|next page|older|more|›|»|→)\s*$"


def _parts(u: Column) -> Column:
    """What the rules read of a URL: itself, its origin, path and query, and its number and shape in a series."""
    split = F.struct(u.alias("u"), U.path(u).alias("p"), U.pairs(U.query(u)).alias("q"))
    return U._let(split, lambda g: F.struct(g["u"].alias("u"), U.origin(g["u"]).alias("origin"), g["p"].alias("p"), g["q"].alias("q"), U._vehicle_number(g["p"], g["q"]).alias("n"), U._shape(g["p"], g["q"]).alias("shape")))


def _legal(now: Column, to: Column) -> Column:
    """As legal_step, of two URLs' parts."""
    path = lambda g: F.regexp_replace(g["p"], "/+$", "")
    told = lambda g, state: F.to_json(F.struct(F.array_sort(F.filter(g["q"], lambda p: F.lower(p["key"]).isin(*U.PAGE_KEYS) == F.lit(state))).alias("q")))
    follows = (to["n"] == F.coalesce(now["n"], F.lit(1)) + 1) & (now["shape"] == to["shape"])
    same_rest = (path(now) == path(to)) & (told(now, False) == told(to, False))

    def legal(same: Column) -> Column:
        plain = ~U._special(to["p"], to["q"]) | same
        return F.coalesce(plain & (follows | (same & (told(now, True) != told(to, True)))), F.lit(False))

    return U._let(same_rest, legal)


def legal_step(current: Column, candidate: Column) -> Column:
    """Whether a URL is the next member of the current one's series, or changes nothing but its page state."""
    return U._let(F.struct(_parts(current).alias("now"), _parts(candidate).alias("to")), lambda g: _legal(g["now"], g["to"]))


def _offset_step(members: Column) -> Column:
    """The next member (offset, t) of one row-offset pager: its smallest gap beyond the current offset."""
    offsets = lambda m: F.array_sort(F.array_distinct(F.transform(m, lambda x: x["offset"])))
    gap = lambda o: F.array_min(F.zip_with(F.slice(o, 2, F.greatest(F.size(o), F.lit(1))), F.slice(o, 1, F.greatest(F.size(o) - 1, F.lit(0))), lambda b, a: b - a))
    first = lambda m, step: F.array_min(F.filter(m, lambda x: x["offset"] == x["at"] + step))
    return U._let(members, lambda m: U._let(U._let(offsets(m), gap), lambda step: first(m, step)))


def next_vehicle_pages(links: DataFrame, by: list[str], url: str = "url", selector: str | None = None, visited: DataFrame | None = None) -> DataFrame:
    """(by..., next_url, reason): a configured control, rel=next, a label or the next number; else a series or offsets.

    links as of html.links; visited: (by..., key) canonical URLs of pages already read. The links are read once: each
    becomes what the rules need of it, and a page's candidates are met in the aggregations of next_in_series,
    next_by_offset and the direct rules together.
    """
    given = links
    if visited is not None:
        given = links.withColumn("key", U.canonical_page_url(U.collapse_page_keys(F.col("target")))).join(visited, [*by, "key"], "left_anti")
    control = F.when(F.lit(selector is not None) & (F.col("selector") == (selector or "")), 0).when(F.array_contains(F.split("rel", " "), "next"), 2).when(F.col("text").rlike(LABEL) | F.col("label").rlike(LABEL), 3)

    def facts(now: Column, to: Column) -> Column:
        number = F.when(to["n"] == F.coalesce(now["n"], F.lit(1)) + 1, 4)
        listed = F.coalesce(~U._special(to["p"], to["q"]) & to["p"].rlike(U.INVENTORY_PATH), F.lit(False))
        state = U._let(F.struct(U._offset(now["q"]).alias("now"), U._offset(to["q"]).alias("to")), lambda o: F.when(o["to"].isNotNull() & F.coalesce(o["to"]["key"] == o["now"]["key"], F.lit(True)), F.struct(o["to"]["offset"].alias("offset"), F.coalesce(o["now"]["offset"], F.lit(0)).alias("at"))))
        read = F.struct(
            to["u"].alias("t"), F.concat(to["origin"], to["shape"]).alias("shape"), F.when(_legal(now, to), F.coalesce(control, number)).alias("r"),
            F.when(listed, to["n"]).alias("n"), F.coalesce(now["n"], F.lit(1)).alias("at"), F.when(listed, state).alias("state"),
        )
        return F.when((F.col("disabled") == 0) & (to["origin"] == now["origin"]), read)

    both = F.struct(_parts(F.col(url)).alias("now"), _parts(U.collapse_page_keys(F.col("target"))).alias("to"))
    read = given.select(*by, "link_no", U._let(both, lambda g: facts(g["now"], g["to"])).alias("f"))
    # no filter on f: it would be moved below, and f with it, to be evaluated twice
    long = lambda c: c.cast("bigint")
    f, no = F.col("f"), F.col("link_no")
    series = read.groupBy(*by, F.col("f.shape").alias("shape")).agg(
        F.min(F.when(f["r"].isNotNull(), F.struct(f["r"].alias("r"), long(no).alias("at"), f["t"].alias("next_url")))).alias("direct"),
        F.min(f["n"]).alias("low"), F.max(f["n"]).alias("high"),
        F.min(F.when(f["n"] > f["at"], F.struct(F.lit(1).alias("r"), f["n"].alias("at"), f["t"].alias("next_url")))).alias("series"),
        F.collect_list(F.when(f["state"].isNotNull(), F.struct(F.col("f.state.offset").alias("offset"), no.alias("link_no"), f["t"].alias("t"), F.col("f.state.at").alias("at")))).alias("members"),
    )
    offset = U._let(_offset_step(F.col("members")), lambda m: F.when(m.isNotNull(), F.struct(F.lit(5).alias("r"), m["offset"].alias("at"), m["t"].alias("next_url"))))
    best = series.select(*by, F.least("direct", F.when(F.col("low") < F.col("high"), F.col("series")), offset).alias("b"))
    found = best.groupBy(*by).agg(F.min("b").alias("b"))
    reason = F.element_at(F.array(*map(F.lit, REASONS)), F.col("b.r") + 1)
    return found.where("b is not null").select(*by, "b.next_url", reason.alias("reason"))
