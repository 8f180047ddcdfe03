"""Whose page a detail page is: VINs that its elements state, URLs that it advertises, and the proof of its identity.

One pass over the DOM collects what elements say; which VIN is the page's own, and whether that is proven, are Column
expressions over these narrow rows.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..dom import Node
from ..functions import url as U
from ..functions import vin as V
from .html import per_page
from .structured import plain_key

#: Names of regions about other vehicles, of galleries, and attributes and properties that state a VIN.
RELATED = re.compile(
    r"(?i)(?:related|similar|recommended|suggested|other[-_ ]?(?:vehicle|car)|you[-_ ]?(?:may|might)(?:[-_ ]?also)?[-_ ]?like|also[-_ ]?like|recently[-_ ]?viewed|"
    r"compare[-_ ]?(?:vehicle|car)|compare[-_ ]?veh(?:icle)?|more[-_ ]?(?:vehicle|car)|inventory[-_ ]?(?:rail|carousel)|featured[-_ ]?products)"
)
GALLERY = re.compile(
    r"(?i)(?:gallery|galleria|photos?|images?|vehicle[-_ ]?media|media[-_ ]?(?:viewer|carousel)|vdp[-_ ]?(?:media|carousel|slider)|vehicle[-_ ]?vdp[-_ ]?slider|"
    r"image[-_ ]?(?:viewer|carousel|slider)|slick[-_ ]?slider)"
)
VIN_ATTRIBUTES = ("data-vin", "data-vehicle-vin", "data-vin-number")
VIN_PROPERTIES = ("vin", "vehicleidentificationnumber")
ADVERTISED = ('link[rel~="canonical"][href]', 'meta[property="og:url"][content]', 'meta[name="twitter:url"][content]')
_TOKEN = re.compile(r"\b[A-HJ-NPR-Z0-9]{17}\b")


def marks(node: Node) -> str:
    return " ".join(node.get(a, "") for a in ("id", "class", "role", "aria-label", "data-testid", "data-component"))


def related(node: Node, scope: Node) -> bool:
    """Whether a node lies in a region about other vehicles, by a name of an element around it or a section's heading."""
    for at in (node, *node.ancestors()):
        if at is scope:
            return False
        if RELATED.search(marks(at)):
            return True
        heading = at.first("h1,h2,h3,h4,h5,h6") if at.name in ("section", "aside") else None
        if heading is not None and RELATED.search(heading.text()):
            return True
    return False


def stated_vins(node: Node) -> list[str]:
    """What an element states as a VIN: by attribute, property, form control or a gallery component's own attribute."""
    said = [node.get(a) for a in VIN_ATTRIBUTES]
    if plain_key(node.get("itemprop", "")) in VIN_PROPERTIES:
        said += [node.get("content"), node.text()]
    if node.name == "input" and re.search(r"(?i)(?:^|[^a-z])vin(?:[^a-z]|$)", " ".join(node.get(a, "") for a in ("name", "id", "data-testid"))):
        said += [node.get("value"), node.get("id")]
    if GALLERY.search(node.name):
        said += [v for k, v in node.attrs.items() if plain_key(k) in ("vin", "vehiclevin")]
    return [t for raw in said if raw for t in _TOKEN.findall(raw.upper())]


def scope_of(root: Node, configured: str | None = None, expected: str | None = None) -> Node:
    """A configured root that holds the expected VIN, else the only one; else what a body marks as its main part."""
    boxes = root.select(configured) if configured else []
    if expected and not expected.startswith(V.SURROGATE):
        holding = [b for b in boxes if expected in b.text().upper() or any(expected in v.upper() for n in (b, *b.walk()) for v in n.attrs.values() if v)]
        if len(holding) == 1:
            return holding[0]
    if len(boxes) == 1:
        return boxes[0]
    return root.first('body [itemtype*="schema.org/Vehicle"],body [itemtype*="schema.org/Car"]') or root.first("main") or root.first("body") or root


def page_evidence(pages: DataFrame, configured: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """(page url, scope_vins, document_vins, advertised): VINs stated outside of related regions, and advertised identities."""
    texts = ArrayType(StringType())
    made = StructType([StructField("scope_vins", texts), StructField("document_vins", texts), StructField("advertised", texts)])

    def rows(root: Node, _: dict[str, Any]) -> list[dict[str, Any]]:
        body = root.first("body") or root
        scope = scope_of(root, configured)
        stated = lambda top: list(dict.fromkeys(v for n in (top, *top.walk()) for v in stated_vins(n) if not related(n, top)))
        told = [n.get("href") or n.get("content") for s in ADVERTISED for n in root.select(s)]
        return [{"scope_vins": stated(scope), "document_vins": stated(body), "advertised": list(dict.fromkeys(t for t in told if t))}]

    found = per_page(pages, html, [url], made, rows)
    real = lambda c: F.array_distinct(F.filter(F.transform(c, lambda v: V.clean_vin(v)), lambda v: v.isNotNull() & ~V.is_surrogate(v)))
    named = F.array_distinct(F.filter(F.transform("advertised", lambda a: U.normalize_detail_url(a)), lambda a: a.isNotNull()))
    return found.select(url, real("scope_vins").alias("scope_vins"), real("document_vins").alias("document_vins"), named.alias("advertised"))


def several_vins(document_vins: Column) -> Column:
    """Whether a document states more than one VIN, which proves none of them."""
    return F.size(F.array_distinct(document_vins)) > 1


def page_identity(evidence: DataFrame, url: str = "url") -> DataFrame:
    """Add primary_vin, proven_by and identity_proven to rows of page_evidence with structured_vin and expected_vin.

    The page's VIN is what its scope states alone, else what the URL that it advertises has, else what its document
    states alone, else the structured one. It must agree with the URL's own VIN and with the expected one, and a page
    that advertises another vehicle's URL proves nothing.
    """
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    told = F.array_distinct(F.filter(F.transform("advertised", lambda a: V.vin_from_url(F.concat(F.lit("https://"), a))), lambda v: v.isNotNull()))
    ways = [("scope", only(F.col("scope_vins"))), ("advertised", U._let(told, only)), ("document", only(F.col("document_vins"))), ("structured", F.col("structured_vin"))]
    same_page = (F.size("advertised") == 0) | U._let(U.normalize_detail_url(F.col(url)), lambda own: F.exists("advertised", lambda a: U.same_advertised(own, a)))
    real = F.when(~V.is_surrogate(F.col("expected_vin")), F.col("expected_vin"))
    # the first way that tells a VIN: later ones are not looked at
    first = F.coalesce(*(U._let(v, lambda x: F.when(x.isNotNull(), F.struct(x.alias("vin"), F.lit(n).alias("by")))) for n, v in ways))  # noqa: B023

    def judged(w: Column) -> Column:
        primary, own = w["first"]["vin"], w["own"]
        fits = (own.isNull() | (own == primary)) & (w["real"].isNull() | (w["real"] == primary))
        return F.struct(primary.alias("primary_vin"), w["first"]["by"].alias("proven_by"), F.coalesce(primary.isNotNull() & fits & ((w["real"] == primary) | same_page), F.lit(False)).alias("identity_proven"))

    read = F.struct(first.alias("first"), V.vin_from_url(F.col(url)).alias("own"), real.alias("real"))
    return evidence.withColumn("__i", U._let(read, judged)).select(*evidence.columns, "__i.*")
