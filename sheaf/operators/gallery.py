"""Photos of detail pages: candidates of each image element, album keys of image hosts, and the proof that a gallery is a vehicle's.

The DOM gives every candidate URL of every image with where it stood; ranking, renditions, ownership and caps are Column
expressions and one aggregation for each page.
"""

from __future__ import annotations

from functools import reduce
from typing import Any
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..dom import Node
from ..functions import photo as P
from ..functions import url as U
from ..functions import vin as V
from .html import jsonld_of, per_page
from .identity import GALLERY, marks, related, scope_of

#: Strength of a candidate by its source, to which a tenth of its width is added.
PRIORITY = {"known_cdn_full": 925, "data_full": 900, "base_img": 880, "pin_media": 860, "gallery_anchor": 850, "srcset": 700, "lazy_src": 500, "background_image": 400, "img_src": 300}
#: Attributes of image elements and the source that each stands for.
SOURCES = (("data-full", "data_full"), ("data-base-img-url", "base_img"), ("data-pin-media", "pin_media"), ("data-srcset", "srcset"), ("srcset", "srcset"), ("data-src", "lazy_src"), ("data-lazy-src", "lazy_src"), ("data-original", "lazy_src"), ("src", "img_src"))
#: Fixed values: (album kind, host, pattern of the path); the groups name a vehicle's album.
ALBUMS = (
    ("autoscout", "prod.pictures.autoscout24.net", r"(?i)^/listing-images/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})_[A-Za-z0-9_-]{8,160}\.(?:jpe?g|png|webp)$"),
    ("sm360", "img.sm360.ca", r"(?i)^/images/inventory/([A-Za-z0-9_-]{1,128}/[A-Za-z0-9_-]{1,80}/[A-Za-z0-9_-]{1,80}/(?:19|20)\d{2}/\d{1,12})/[A-Za-z0-9][A-Za-z0-9._-]{0,255}\.(?:jpe?g|png|webp|avif)$"),
    ("birchwood", "vehicle-photos.birchwood.ca", r"(?i)^/photos/vehicles/(\d{1,12})/\d{1,16}-large\.jpg$"),
    ("carscommerce", "vehicle-images.carscommerce.inc", r"(?i)^/[0-9a-f]{1,8}-\d{1,12}/([A-HJ-NPR-Z0-9]{17})/(?:thumbnails/[a-z0-9_-]{1,32}/)?[A-Za-z0-9][A-Za-z0-9._-]{0,255}\.(?:png|jpe?g|webp)$"),
    ("remora", "vimg.remora.inc", r"(?i)^/\d{1,12}/([A-HJ-NPR-Z0-9]{17})-[A-Za-z0-9][A-Za-z0-9._-]{0,255}\.avif$"),
)
#: Hosts whose galleries have no album in their paths: (kind, host, pattern of the path).
FLAT = (
    ("dealereprocess", "cloudflareimages.dealereprocess.com", r"(?i)^/resrc/images/(?:c_limit,)?fl_lossy,w_(?:auto|\d{2,5})/v1/dvp/\d{1,10}/[A-Za-z0-9_-]{8,128}/[A-Za-z0-9%][A-Za-z0-9%._~+()=-]{7,511}$"),
    ("dealercenter", "imagescf.dealercenter.net", r"(?i)^/\d{1,5}/\d{1,5}/(?:19|20)\d{2}(?:0[1-9]|1[0-2])-[0-9a-f]{32}\.jpe?g$"),
)
BRANDING = r"(?i)(?:^|[-_\s])(?:dealer(?:ship)?|brand(?:ing)?|logo|wordmark)(?:$|[-_\s])"
#: Where a dealer's own photos are, what is one, and how many are kept.
OWN_PHOTO, OWN_CAP = r"https://pictures\.dealer\.com/m/[^\s\"'<>?]+?\.jpe?g", 40
STATIC_IMAGE = r"(?i)https?://[^\s\"'<>\\]{8,300}\.(?:jpe?g|png|webp)"


def album(u: Column) -> Column:
    """The key of the vehicle's album on a known image host, else null."""
    keyed = [F.when((U.host(u) == h) & U.path(u).rlike(p), F.concat(F.lit(f"{kind}:"), F.upper(F.regexp_extract(U.path(u), p, 1)) if kind in ("carscommerce", "remora") else F.lower(F.regexp_extract(U.path(u), p, 1)))) for kind, h, p in ALBUMS]
    short = lambda k: F.when(k.startswith("sm360:"), F.regexp_replace(k, r"^sm360:([^/]*)/.*/(\d+)$", "sm360:$1/$2")).otherwise(k)
    return short(F.coalesce(*keyed))


def flat_grammar(u: Column) -> Column:
    """Which host's path shape without albums a photo has, else null."""
    return F.coalesce(*(F.when((U.host(u) == h) & U.path(u).rlike(p), F.lit(kind)) for kind, h, p in FLAT))


def vins_in(u: Column) -> Column:
    """The VINs that a photo's URL names."""
    raw = F.regexp_extract_all(F.upper(u), F.lit(r"(?<![A-Z0-9])([A-HJ-NPR-Z0-9]{17})(?![A-Z0-9])"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, lambda v: V.clean_vin(v)), lambda v: v.isNotNull() & ~V.is_surrogate(v))))


def same_image(base: Column, variant: Column) -> Column:
    """Whether one URL is a sized variant of another: equal but for more query arguments."""
    place = lambda u: F.concat_ws("|", U.scheme(u), U.netloc(u), U.path(u))
    told = lambda u: F.transform(U.pairs(U.query(u)), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return (place(base) == place(variant)) & (F.size(F.array_except(told(base), told(variant))) == 0)


def declared_width(u: Column) -> Column:
    """The width that a rendition's path declares, on the one host where the first two numbers are a size."""
    width = F.regexp_extract(U.path(u), r"^/(\d{1,5})/\d{1,5}/", 1).try_cast("int")
    return F.when((U.host(u) == "imagescf.dealercenter.net") & width.between(1, 20_000), width)


def wider(photo: Column, base: Column) -> Column:
    """A declared base image instead of a photo, if it is the same asset and strictly wider."""
    better = (P.asset_key(photo) == P.asset_key(base)) | (F.regexp_extract(U.path(photo), "([^/]*)$", 1) == F.regexp_extract(U.path(base), "([^/]*)$", 1))
    return F.when(better & (declared_width(base) > declared_width(photo)), base).otherwise(photo)


def enough_static_photos(html: Column, least: int = 3) -> Column:
    """Whether a page's markup names enough different images for a gallery of its own."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.substring(html, 1, 1_500_000), F.lit(STATIC_IMAGE), 0))) >= least


def quick_gallery(html: Column, declared: Column) -> Column:
    """A dealer's own photos, those that structured data declares first, each asset once, OWN_CAP at most."""
    own = lambda c: F.filter(F.transform(c, lambda u: F.regexp_extract(u, f"(?i)^{OWN_PHOTO}$", 0)), lambda u: u != "")
    named = F.transform(F.coalesce(declared, F.array().cast("array<string>")), lambda u: F.split_part(u, F.lit("?"), F.lit(1)))
    found = F.concat(own(named), F.regexp_extract_all(html, F.lit(f"(?i){OWN_PHOTO}"), 0))
    key = lambda u: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(u, "([^/]*)$", 1), r"(?i)\.jpe?g$", ""), "^thumb_", ""), "x$", "")
    first = F.aggregate(
        found,
        F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("urls")),
        lambda s, u: F.when(F.array_contains(s["keys"], key(u)), s).otherwise(F.struct(F.array_append(s["keys"], key(u)).alias("keys"), F.array_append(s["urls"], u).alias("urls"))),
        lambda s: s["urls"],
    )
    return F.slice(first, 1, OWN_CAP)


def _containers(root: Node, scope: Node, configured: str | None) -> list[Node]:
    """Galleries of a scope: the configured one, else the outermost regions that are named so; none about other vehicles."""
    if configured:
        return [b for b in scope.select(configured) if not related(b, scope)]
    named = [n for n in scope.walk() if GALLERY.search(marks(n)) and not n.name == "img" and any(x.name == "img" for x in n.walk()) and not related(n, scope)]
    return [n for n in named if not any(a in named for a in n.ancestors())]


def _candidates(node: Node, base: str) -> list[tuple[str, str, int]]:
    """(url, source, width) that an image element or gallery link offers."""
    out: list[tuple[str, str, int]] = []
    for attribute, source in SOURCES:
        value = node.get(attribute, "").strip()
        if not value:
            continue
        if source == "srcset":
            for part in value.split(", "):
                target, _, size = part.strip().rstrip(",").partition(" ")
                out.append((target, source, int(size[:-1]) if size.endswith("w") and size[:-1].isdigit() else 0))
        else:
            width = node.get("width", "")
            out.append((value, "srcset" if source == "img_src" and width.isdigit() and int(width) >= 1000 else source, int(width) if width.isdigit() else 0))
    if node.name == "a" and node.first("img") is not None and node.get("href"):
        out.append((node.get("href"), "gallery_anchor", 0))
    style = node.get("style", "")
    if "background-image" in style and "url(" in style:
        out.append((style.split("url(", 1)[1].split(")")[0].strip("'\" "), "background_image", 0))
    return [(urljoin(base, u), s, w) for u, s, w in out]


def photo_candidates(pages: DataFrame, root: str | None = None, gallery: str | None = None, item: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """(page url, galleries, ord, element, photo, source, width, label, branded) of all candidates in the page's one gallery."""
    made = StructType([StructField("galleries", IntegerType()), StructField("ord", IntegerType()), StructField("element", IntegerType())] + [StructField(n, StringType()) for n in ("photo", "source")] + [StructField("width", IntegerType()), StructField("label", StringType())])

    def rows(top: Node, row: dict[str, Any]) -> list[dict[str, Any]]:
        scope = scope_of(top, root)
        boxes = _containers(top, scope, gallery)
        if len(boxes) != 1:
            return []
        # an anchor around an image and the image are one element
        shown = boxes[0].select(item) if item else [n for n in boxes[0].walk() if n.name in ("img", "source") or n.name == "a" and n.first("img") is not None or "background-image" in n.get("style", "")]
        elements = [n for n in shown if not any(a in shown for a in n.ancestors())]
        out: list[dict[str, Any]] = []
        for k, n in enumerate(elements):
            inner = [n, *(x for x in n.walk() if x.name in ("img", "source", "a"))]
            label = " ".join(x.get(a, "") for x in inner for a in ("alt", "title", "aria-label", "id", "class"))
            out += [{"galleries": 1, "ord": len(out) + j, "element": k, "photo": u, "source": s, "width": w, "label": " ".join(label.split())} for j, (u, s, w) in enumerate(c for x in inner for c in _candidates(x, row[url] or ""))]
        return out

    return per_page(pages, html, [url], made, rows).withColumn("branded", F.col("label").rlike(BRANDING))


def declared_photos(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page url, declared): image URLs of the page's JSON-LD."""
    made = StructType([StructField("declared", ArrayType(StringType()))])

    def rows(root: Node, row: dict[str, Any]) -> list[dict[str, Any]]:
        images = [i for n in jsonld_of(root) for i in (n.get("image") if isinstance(n.get("image"), list) else [n.get("image")])]
        urls = [i.get("url") or i.get("contentUrl") if isinstance(i, dict) else i for i in images]
        return [{"declared": list(dict.fromkeys(urljoin(row[url] or "", u) for u in urls if isinstance(u, str) and u))}]

    return per_page(pages, html, [url], made, rows)


def best_photos(candidates: DataFrame, url: str = "url") -> DataFrame:
    """One photo of each element: full size by its host's rule, else the strongest and widest candidate of an accepted image.

    A width that an image's srcset declares holds for its other candidates of the same asset.
    """
    full = candidates.where(~F.col("branded")).withColumn("f", P.full_size(F.col("photo"))).withColumn("source", F.when(F.col("f.full"), "known_cdn_full").otherwise(F.col("source")))
    shown = full.withColumn("photo", F.col("f.url")).withColumn("width", F.greatest("width", F.coalesce("f.width", declared_width(F.col("photo")), F.lit(0)))).where(P.accepted_image(F.col("photo")))
    shown = shown.withColumn("asset", P.asset_key(F.col("photo")))
    strength = F.coalesce(*(F.when(F.col("source") == s, F.lit(n)) for s, n in PRIORITY.items()), F.lit(0)) + F.floor(F.least("width", F.lit(9999)) / 10)
    each = shown.groupBy(url, "element", "asset").agg(F.min("ord").alias("ord"), F.max("width").alias("width"), F.max_by(F.struct("photo", "source", "label"), F.struct(strength.alias("s"), (-F.col("ord")).alias("o"))).alias("best"), F.max(strength).alias("strength"))
    top = each.groupBy(url, "element").agg(F.max_by(F.struct("ord", "asset", "width", "best"), F.struct("strength", "width", (-F.col("ord")).alias("o"))).alias("b"))
    return top.select(url, "element", "b.ord", "b.asset", "b.width", F.col("b.best.photo").alias("photo"), F.col("b.best.source").alias("source"), F.col("b.best.label").alias("label"))


def proven_galleries(photos: DataFrame, vehicles: DataFrame, url: str = "url") -> DataFrame:
    """(page url, proven_by, photos): whether a page's gallery is its vehicle's, and the photos, each asset once.

    photos: rows of best_photos; vehicles: (page url, expected_vin, identity_proven, declared, year, make, model). A
    gallery of two photos at least proves itself if every label names the VIN; if every URL does, on a proven page; or
    on a proven page of full-size photos, if all lie in one album that a declared photo shares, or if all have one flat
    path shape and every label names year, make and model. A photo of another VIN proves that it is not.
    """
    joined = photos.join(vehicles, url)
    expected = F.when(~V.is_surrogate(F.col("expected_vin")), F.col("expected_vin"))
    in_label, in_url = vins_in(F.col("label")), vins_in(F.col("photo"))
    named = lambda c: (F.size(c) == 1) & (F.get(c, F.lit(0)) == expected)
    foreign = F.exists(F.concat(in_label, in_url), lambda v: v != expected)
    words = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))) for c in ("year", "make", "model")]
    told = reduce(lambda a, b: a & b, (F.contains(F.lower("label"), w) for w in words))
    own_albums = F.transform(F.coalesce("declared", F.array().cast("array<string>")), lambda d: album(d))
    g = joined.groupBy(url).agg(
        F.count_distinct("asset").alias("n"), F.first("identity_proven").alias("identity"), F.bool_or(foreign).alias("foreign"), F.bool_and(named(in_label)).alias("labels"), F.bool_and(named(in_url)).alias("urls"),
        F.bool_and(F.col("source") == "known_cdn_full").alias("full"), F.count_distinct(album(F.col("photo"))).alias("albums"), F.bool_and(album(F.col("photo")).isNotNull()).alias("all_albums"),
        F.bool_or(F.array_contains(own_albums, album(F.col("photo")))).alias("declared_album"), F.count_distinct(flat_grammar(F.col("photo"))).alias("grammars"), F.bool_and(flat_grammar(F.col("photo")).isNotNull()).alias("all_flat"), F.bool_and(told).alias("told"),
        F.array_sort(F.collect_list(F.struct("ord", "photo", "asset"))).alias("p"), F.bool_and(expected.isNotNull()).alias("real"),
    )
    kept = F.col("real") & (F.col("n") >= 2) & ~F.coalesce("foreign", F.lit(False))
    by = (
        F.when(kept & F.col("labels"), "labels")
        .when(kept & F.col("identity") & F.col("urls"), "urls")
        .when(kept & F.col("identity") & F.col("full") & F.col("all_albums") & (F.col("albums") == 1) & F.col("declared_album"), "album")
        .when(kept & F.col("identity") & F.col("full") & F.col("all_flat") & (F.col("grammars") == 1) & F.col("told"), "flat")
    )
    once = F.aggregate(
        "p",
        F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("urls")),
        lambda s, x: F.when(F.array_contains(s["keys"], x["asset"]), s).otherwise(F.struct(F.array_append(s["keys"], x["asset"]).alias("keys"), F.array_append(s["urls"], x["photo"]).alias("urls"))),
        lambda s: F.slice(s["urls"], 1, 80),
    )
    return g.withColumn("proven_by", by).select(url, "proven_by", F.when(F.col("proven_by").isNotNull(), once).otherwise(F.array().cast("array<string>")).alias("photos"))
