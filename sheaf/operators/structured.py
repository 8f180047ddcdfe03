"""Structured page data beyond JSON-LD: application state, vehicle mappings anywhere in JSON, and microdata."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..dom import Node
from ..functions import url as U
from ..functions import vin as V
from .html import get_path, per_page, types_of

#: Bounds of the walk, keys of fields by priority, feature keys, and keys that mark a vehicle.
DEPTH, BUDGET, CHILDREN = 12, 4000, 500
ALIASES = {
    "vin": ("vehicleidentificationnumber", "vin", "serialnumber"),
    "stock_number": ("stocknumber", "stock", "sku"),
    "year": ("vehiclemodeldate", "modelyear", "modeldate", "year"),
    "make": ("make", "brand"),
    "model": ("model",),
    "trim": ("vehicleconfiguration", "trim", "trimlevel"),
    "name": ("name", "headline"),
    "price": ("displayedprice", "finalprice", "price", "saleprice", "internetprice"),
    "mileage": ("mileagefromodometer", "mileage", "odometer", "km"),
    "distance_unit": ("unitcode", "unittext", "distanceunit", "mileagefromodometerunitcode"),
    "color_ext": ("vehiclecolor", "exteriorcolor", "baseextcolor", "color"),
    "color_int": ("vehicleinteriorcolor", "interiorcolor", "baseintcolor"),
    "transmission": ("vehicletransmission", "transmission", "transtype"),
    "drivetrain": ("drivetrain", "drive", "drivetype"),
    "engine": ("vehicleengine", "engine", "enginename"),
    "fuel": ("fueltype", "fuel"),
    "body_type": ("vehiclebodytype", "bodytype", "body"),
    "condition": ("itemcondition", "condition", "saleclass", "status"),
    "description": ("shortdescriptionlocalized", "shortdescription", "descriptionfr", "descriptionen", "description"),
}
FEATURES = frozenset("features featurelist options option vehicleoptions vehicleoptionsfr vehicleoptionsen equipment standardfeatures additionalproperty".split())
VEHICLE_KEYS = frozenset("year modelyear vehiclemodeldate make brand model trim price mileage odometer stock stocknumber detailurl vehicleurl vdpurl".split())
_TYPE = re.compile(r"(?i)(?:^|[/#])(?:vehicle|car|usedcar|newcar|usedvehicle|newvehicle|motorizedvehicle|truck|suv|van)$")
_VIN = re.compile(r"(?<![A-Z0-9])[A-HJ-NPR-Z0-9]{17}(?![A-Z0-9])")


def plain_key(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", str(key).lower())


def walk(value: Any, depth: int = 0, budget: list[int] | None = None) -> Iterator[dict[str, Any]]:
    """All mappings of a value, from the outside in, within the bounds."""
    budget = [BUDGET] if budget is None else budget
    if depth > DEPTH or budget[0] <= 0:
        return
    budget[0] -= 1
    if isinstance(value, dict):
        yield value
    children = value.values() if isinstance(value, dict) else value[:CHILDREN] if isinstance(value, list) else ()
    for child in children:
        yield from walk(child, depth + 1, budget)


def field_of(mapping: dict[str, Any], name: str) -> str | None:
    """A mapping's value of a field: the first alias that it has, as text; of offers only a unanimous price."""
    keys = {plain_key(k): v for k, v in mapping.items()}
    for alias in ALIASES[name]:
        value = keys.get(alias)
        if isinstance(value, list):
            value = value[0] if len(value) == 1 else None
        if isinstance(value, dict):
            value = get_path({"x": value}, "x")
        if value not in (None, "", []) and not isinstance(value, (dict, bool)):
            return " ".join(entities.unescape(str(value)).split()) or None
    if name == "price":
        offers = keys.get("offers")
        prices = {str(p) for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict) and (p := o.get("price")) not in (None, "")}
        return prices.pop() if len(prices) == 1 else None
    return None


def is_vehicle(mapping: dict[str, Any]) -> bool:
    """A vehicle type, a VIN, or two telling keys."""
    if any(_TYPE.search(t) for t in types_of(mapping)) or (v := field_of(mapping, "vin")) and _VIN.search(v.upper()):
        return True
    return len({plain_key(k) for k in mapping} & VEHICLE_KEYS) >= 2


#: Containers of a vehicle's root, beside those of its fields and features, that are its own.
CONTAINERS = frozenset("offers aggregateoffer media vehiclemedia image images photo photos picture pictures gallery".split())


def owned(mapping: dict[str, Any], vin: str | None = None, depth: int = 0) -> dict[str, Any]:
    """A vehicle's mapping without what belongs to others: containers that are not its own, nested vehicles and other VINs."""
    mine = CONTAINERS | FEATURES | {a for names in ALIASES.values() for a in names}

    def keep(value: Any, level: int) -> Any:
        """The value without foreign parts; None stands for nothing left."""
        if level > DEPTH:
            return None
        if isinstance(value, list):
            return [k for v in value[:CHILDREN] if (k := keep(v, level + 1)) is not None]
        if not isinstance(value, dict):
            return value
        own = field_of(value, "vin")
        if own and vin and own.upper() != vin or is_vehicle(value) and (own or "").upper() != (vin or "\0"):
            return None
        return owned(value, vin, level)

    out = {}
    for key, value in mapping.items():
        if depth == 0 and isinstance(value, (dict, list)) and plain_key(key) not in mine:
            continue
        if value is None or (kept := keep(value, depth + 1)) is not None:
            out[key] = kept if value is not None else None
    return out


def _feature_texts(value: Any, depth: int = 0) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, list) and depth < 8:
        for v in value[:160]:
            yield from _feature_texts(v, depth + 1)
    elif isinstance(value, dict) and depth < 8 and not is_vehicle(value):
        for name in ("value", "name", "text"):
            if name in value:
                yield from _feature_texts(value[name], depth + 1)
                return


def states_of(root: Node) -> Iterator[tuple[str, Any]]:
    """(source, value) of vehicle attributes, JSON scripts and assigned state objects; broken JSON is passed over."""

    def read(source: str, raw: str) -> Iterator[tuple[str, Any]]:
        try:
            yield source, json.loads(raw)
        except (ValueError, RecursionError):
            return

    for n in root.walk():
        if n.get("data-vehicle"):
            yield from read("attribute", n.attrs["data-vehicle"])
        if n.name == "script":
            body = "".join(n.strings()).strip()
            kind = n.get("type", "")
            if kind == "application/ld+json":
                yield from read("json_ld", body)
            elif kind == "application/json":
                yield from read("json", body)
            else:
                for m in re.finditer(r"(?:__\w+__|\bstate|DDC\.\w+\.state\s*(?:\[[^\]]{1,80}\])+)\s*=\s*(?=[\[{])", body):
                    try:
                        yield "state", json.JSONDecoder().raw_decode(body[m.end() :])[0]
                    except (ValueError, RecursionError):
                        continue
                for m in re.finditer(r"__next_f\.push\(\s*(?=\[)", body):
                    try:
                        chunk = json.JSONDecoder().raw_decode(body[m.end() :])[0]
                    except (ValueError, RecursionError):
                        continue
                    for part in chunk[1:] if isinstance(chunk, list) else ():
                        yield from (("flight", value) for value in flight_records(str(part)))


#: A record at its boundary: an id, then text of a declared length in bytes, or a line.
_RECORD = re.compile(rb"[\r\n]*(?:[0-9a-zA-Z]+)?:(?:[Tt]([0-9a-fA-F]{1,8}),|([^\n]*)\n?)")
RECORDS = 512


def flight_records(payload: str) -> Iterator[Any]:
    """JSON values of a flight stream: its records follow one another, and texts of declared length are passed over whole."""
    raw, at = payload.encode("utf-8", "ignore"), 0
    for _ in range(RECORDS):
        m = _RECORD.match(raw, at)
        if m is None:
            return
        if m[1] is not None:
            at = m.end() + int(m[1], 16)
            if at > len(raw):
                return
            continue
        at = m.end()
        if m[2][:1] in (b"{", b"["):
            try:
                yield json.loads(m[2])
            except (ValueError, RecursionError):
                continue


def vehicle_mappings(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page url, source, node_no, fields..., features) of all vehicle mappings, each text of one source once."""
    fields = [StructField("source", StringType()), StructField("node_no", IntegerType()), *(StructField(n, StringType()) for n in ALIASES), StructField("own_url", StringType()), StructField("features", ArrayType(StringType()))]

    def rows(root: Node, _: dict[str, Any]) -> list[dict[str, Any]]:
        out, seen = [], set()
        for source, value in states_of(root):
            for m in walk(value):
                if not is_vehicle(m):
                    continue
                key = (source, json.dumps(m, sort_keys=True, default=str))
                if key in seen:
                    continue
                seen.add(key)
                own = {n: field_of(m, n) for n in ALIASES}
                link = next((v for k, v in m.items() if plain_key(k) in ("url", "detailurl", "vehicleurl", "vdpurl") and isinstance(v, str)), None)
                found = [t for k, v in m.items() if plain_key(k) in FEATURES for t in _feature_texts(v)]
                out.append({"source": source, "node_no": len(out), **own, "own_url": link, "features": found[:160]})
        return out

    return per_page(pages, html, [url], StructType(fields), rows)


def own_mapping(mappings: DataFrame, expected: DataFrame, url: str = "url") -> DataFrame:
    """Of each page the mapping that is its vehicle: of the expected VIN, of the page's URL, of the only VIN, the only one."""
    m = mappings.withColumn("v", V.clean_vin(F.col("vin"))).join(expected, url, "left")
    page = Window.partitionBy(url)
    only_vin = F.size(F.collect_set("v").over(page)) == 1
    only = F.count(F.lit(1)).over(page) == 1
    rank = F.when(F.col("v") == F.col("expected_vin"), 0).when(U.normalize_detail_url(F.col("own_url")) == U.normalize_detail_url(F.col(url)), 1).when(only_vin & F.col("v").isNotNull(), 2).when(only, 3)
    ranked = m.withColumn("rank", rank).where("rank is not null")
    best = ranked.groupBy(url).agg(F.min_by(F.struct(*[c for c in ranked.columns if c != url]), F.struct("rank", "node_no")).alias("b"))
    return best.select(url, "b.*").withColumn("matched_by", F.element_at(F.array(*(F.lit(x) for x in ("vin", "url", "only_vin", "only"))), F.col("rank") + 1)).drop("rank", "v", "expected_vin")


def microdata(pages: DataFrame, names: list[str], scope: str = "body", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: of each itemprop within the scope the value that all its elements agree on, else null."""
    made = StructType([StructField(n, StringType()) for n in names])

    def rows(root: Node, _: dict[str, Any]) -> list[dict[str, Any]]:
        found: dict[str, set[str]] = {}
        shown: dict[str, str] = {}
        boxes = root.select(scope)
        for n in boxes[0].walk() if len(boxes) == 1 else ():
            for prop in n.get("itemprop", "").split():
                value = " ".join((n.get("content") or n.get("datetime") or n.text() or "").split())
                if prop in names and value:
                    found.setdefault(prop, set()).add(value.lower())
                    shown.setdefault(prop, value)
        return [{n: shown[n] if len(found.get(n, ())) == 1 else None for n in names}]

    return per_page(pages, html, [url], made, rows)


def meta_description(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The page's unanimous description, else its unanimous og:description."""

    def rows(root: Node, _: dict[str, Any]) -> list[dict[str, Any]]:
        for selector in ('meta[name="description" i]', 'meta[property="og:description" i]'):
            values = {" ".join(n.get("content", "").split()) for n in root.select(selector)} - {""}
            if len(values) == 1:
                return [{"description": values.pop()}]
        return [{"description": None}]

    return per_page(pages, html, [url], StructType([StructField("description", StringType())]), rows)


def robots_path(c: Column) -> Column:
    """The path of a URL with percent-encoding undone (eight times at most), dot segments and repeated slashes resolved."""
    p = U.path(c)
    for _ in range(8):
        p = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    resolved = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, x)))
    return F.concat(F.lit("/"), F.array_join(resolved, "/"))


def asks_for_robots(c: Column) -> Column:
    return F.lower(robots_path(c)) == "/robots.txt"
