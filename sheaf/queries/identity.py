"""Queries over links, identities, galleries and cards of pages that are made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import gallery as G
from ..operators import identity as I
from ..plans import cards as C
from .registry import query, table

_BASE = "https://www.shop.example.com/list/a.html?p=1"


def _ref(k: Column) -> Column:
    s = k.cast("string")
    return F.element_at(
        F.array(F.concat(F.lit("/v/"), s), F.concat(F.lit("http://www.shop.example.com/v/"), s, F.lit("#x")), F.concat(F.lit("https://other.example.com/v/"), s), F.concat(F.lit("../v/"), s, F.lit("?b=1")), F.concat(F.lit("/{{url}}/"), s), F.concat(F.lit("v\\"), s), F.concat(F.lit("my photo "), s, F.lit(".jpg")), F.concat(F.lit("/bad%zz/"), s)),
        (k % 8 + 1).cast("int"),
    )


@query("""
WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS m, 'https://www.shop.example.com' AS w FROM customer)
SELECT k,
  CASE m WHEN 0 THEN w || '/v/' || k WHEN 1 THEN w || '/v/' || k WHEN 3 THEN w || '/v/' || k || '?b=1' WHEN 6 THEN w || '/list/my photo ' || k || '.jpg' WHEN 7 THEN w || '/bad%zz/' || k END AS own,
  CASE m WHEN 0 THEN w || '/v/' || k WHEN 1 THEN w || '/v/' || k WHEN 3 THEN w || '/v/' || k || '?b=1' WHEN 6 THEN w || '/list/my photo ' || k || '.jpg' WHEN 7 THEN w || '/bad%zz/' || k END AS dealer,
  CASE m WHEN 0 THEN w || '/v/' || k WHEN 1 THEN 'http://www.shop.example.com/v/' || k WHEN 2 THEN 'https://other.example.com/v/' || k WHEN 3 THEN w || '/v/' || k || '?b=1' WHEN 6 THEN w || '/list/my%20photo%20' || k || '.jpg' END AS data
FROM c""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and data URLs of a page, resolved and sanitised."""
    k, base = F.col("c_custkey"), F.lit(_BASE)
    ref = _ref(k)
    return table(spark, sf_dir, "customer").select(k.alias("k"), U.same_origin_url(base, ref, F.lit("https://www.shop.example.com")).alias("own"), U.dealer_url(base, ref, F.lit("https://shop.example.com")).alias("dealer"), U.safe_data_url(base, ref).alias("data"))


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey || '-b' || ',' || 'k00' || c_custkey ELSE 'k00' || c_custkey END AS keys,
  'https://x.example/' || c_custkey || ',http://y.example' AS urls FROM customer""")
def key_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock keys and URL lists, normalised."""
    s = F.col("c_custkey").cast("string")
    keys = F.array(F.concat(F.lit(" K00"), s), F.concat(F.lit("k00"), s), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("A"), s, F.lit("%2Db"))), F.lit("nodigit"), F.lit("{{1}}"))
    urls = F.array(F.concat(F.lit(" x.example/"), s), F.lit(""), F.lit("http://y.example"), F.concat(F.lit("https://x.example/"), s))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.array_join(U.stock_keys(keys), ",").alias("keys"), F.array_join(U.url_list(urls), ",").alias("urls"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1, 2) AS same FROM part")
def advertised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail identities and what their pages advertise: equal, of one slug, in another presentation, of another vehicle."""
    s = F.col("p_partkey").cast("string")
    asked = F.concat(F.lit("shop.example.com/used/"), F.lit("fine-car-number-1"), s)
    told = F.element_at(F.array(asked, F.concat(F.lit("shop.example.com/parts/fine-car-number-1"), s), F.concat(asked, F.lit("?payment_type=cash")), F.concat(F.lit("shop.example.com/used/fine-car-number-2"), s)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", U.same_advertised(asked, told).alias("same"))


def _vin(salt: str) -> Column:
    """A VIN of digits and letters for a part."""
    return F.concat(F.lit("1FB"), F.upper(F.substring(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(salt))), 1, 12)), F.lit("77"))


def _vin_sql(salt: str) -> str:
    return f"'1FB' || upper(substr(md5(p_partkey || '{salt}'), 1, 12)) || '77'"


@query(f"""
SELECT p_partkey, CASE WHEN m <> 1 THEN {_vin_sql("a")} END AS primary_vin,
  CASE m WHEN 0 THEN 'scope' WHEN 2 THEN 'document' WHEN 3 THEN 'structured' END AS proven_by, m IN (0, 2) AS identity_proven, m = 1 AS several
FROM (SELECT p_partkey, p_partkey % 4 AS m FROM part)""")
def page_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose page it is: a VIN in the main part, two of them, one in a form, none; other vehicles' regions state theirs too."""
    m, vin, other = F.col("p_partkey") % 4, _vin("a"), _vin("b")
    inner = F.when(m == 0, F.concat(F.lit('<main data-vin="'), vin, F.lit('"><p>car</p>'))).when(m == 1, F.concat(F.lit("<main><i itemprop=vin>"), vin, F.lit("</i><b data-vehicle-vin="), other, F.lit("></b>"))).otherwise(F.lit("<main><p>car</p>"))
    rest = F.concat(F.lit("</main><section><h2>Similar vehicles</h2><div data-vin="), other, F.lit("></div></section>"), F.when(m == 2, F.concat(F.lit('<form><input name="lead-vin" value="'), vin, F.lit('"></form>'))).otherwise(""))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://shop.example.com/vdp/"), F.col("p_partkey").cast("string")).alias("url"), F.concat(F.lit("<html><body>"), inner, rest, F.lit("</body></html>")).alias("html"), vin.alias("vin"), other.alias("other"), m.alias("m"))
    told = I.page_evidence(pages.select("url", "html")).join(pages.select("url", "p_partkey", "m", F.when(F.col("m") == 3, F.col("vin")).alias("structured_vin"), F.when(F.col("m") == 3, F.col("other")).otherwise(F.col("vin")).alias("expected_vin")), "url")
    return I.page_identity(told).select("p_partkey", "primary_vin", "proven_by", "identity_proven", I.several_vins(F.col("document_vins")).alias("several"))


@query("""
SELECT p_partkey, 'https://pictures.dealer.com/m/shop/' || p_partkey || '.jpg' || CASE WHEN p_partkey % 3 > 0 THEN ',https://pictures.dealer.com/m/shop/b' || p_partkey || 'x.jpg' ELSE '' END AS photos,
  p_partkey % 3 = 2 AS enough FROM part""")
def quick_galleries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    first = F.concat(F.lit("https://pictures.dealer.com/m/shop/"), s, F.lit(".jpg"))
    more = F.concat(F.lit('<img src="https://pictures.dealer.com/m/shop/b'), s, F.lit('x.jpg?impolicy=downsize"><img src="https://pictures.dealer.com/m/shop/b'), s, F.lit('.jpg">'))
    html = F.concat(F.lit('<img src="'), first, F.lit('?w=1"><img src="https://pictures.dealer.com/f/stock.jpg"><img src="/x.png">'), F.when(m > 0, more).otherwise(""), F.when(m == 2, '<img src="https://c.example/other.webp?w=2">').otherwise(""))
    enough = G.enough_static_photos(html, 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(G.quick_gallery(html, F.array(F.concat(first, F.lit("?w=9")))), ",").alias("photos"), enough.alias("enough"))


@query(f"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'sm360:shop/' || p_partkey WHEN 1 THEN 'carscommerce:' || {_vin_sql("a")} WHEN 2 THEN 'birchwood:' || p_partkey END AS album,
  CASE WHEN p_partkey % 4 = 3 THEN 'dealercenter' END AS flat, CASE WHEN p_partkey % 4 = 1 THEN {_vin_sql("a")} ELSE '' END AS vins, CASE WHEN p_partkey % 4 = 3 THEN 640 END AS width,
  CASE WHEN p_partkey % 4 = 3 THEN 1600 END AS wider, p_partkey % 2 = 0 AS variant FROM part""")
def photo_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums, flat path shapes, VINs and declared sizes of photo URLs."""
    s, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    flat = lambda w: F.concat(F.lit(f"https://imagescf.dealercenter.net/{w}/480/202401-"), F.md5(s), F.lit(".jpg"))
    u = F.when(m == 0, F.concat(F.lit("https://img.sm360.ca/images/inventory/shop/ford/f150/2020/"), s, F.lit("/a.jpg"))).when(m == 1, F.concat(F.lit("https://vehicle-images.carscommerce.inc/1a-22/"), _vin("a"), F.lit("/thumbnails/large/a.png"))).when(m == 2, F.concat(F.lit("https://vehicle-photos.birchwood.ca/photos/vehicles/"), s, F.lit("/12-large.jpg"))).otherwise(flat(640))
    variant = F.concat(u, F.when(m % 2 == 0, "?w=9").otherwise("x?w=9"))
    return table(spark, sf_dir, "part").select("p_partkey", G.album(u).alias("album"), G.flat_grammar(u).alias("flat"), F.array_join(G.vins_in(u), ",").alias("vins"), G.declared_width(u).alias("width"), G.declared_width(G.wider(u, F.when(m == 3, flat(1600)).otherwise(u))).alias("wider"), G.same_image(u, variant).alias("variant"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'labels' WHEN 1 THEN 'album' END AS proven_by, CASE WHEN p_partkey % 4 = 0 THEN 2 WHEN p_partkey % 4 = 1 THEN 3 ELSE 0 END AS photos FROM part""")
def gallery_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Galleries proven by labels and by albums; one of foreign photos and two galleries in one page prove nothing."""
    s, m, vin = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4, _vin("a")
    named = lambda n, v: F.concat(F.lit('<img alt="car '), v, F.lit(f'" srcset="https://c.example/{n}-'), s, F.lit(f'.jpg 640w, https://c.example/{n}-'), s, F.lit('.jpg 1600w">'))
    logo = F.lit('<img alt="dealer logo" src="https://c.example/l.jpg">')
    birch = lambda n: F.concat(F.lit('<a href="https://vehicle-photos.birchwood.ca/photos/vehicles/'), s, F.lit(f'/{n}-large.jpg"><img src="https://vehicle-photos.birchwood.ca/photos/vehicles/'), s, F.lit(f'/{n}-small.jpg"></a>'))
    box = F.when(m == 0, F.concat(named("a", vin), named("b", vin), named("a", vin), logo)).when(m == 1, F.concat(birch(1), birch(2), birch(3))).when(m == 2, F.concat(named("a", vin), named("b", _vin("b")))).otherwise(F.concat(named("a", vin), F.lit("</div><div class=gallery>"), named("b", vin)))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://shop.example.com/vdp/"), s).alias("url"), F.concat(F.lit("<html><body><main><div class=gallery>"), box, F.lit('</div></main><script type="application/ld+json">{"@type":"Car","image":["https://vehicle-photos.birchwood.ca/photos/vehicles/'), s, F.lit('/1-large.jpg"]}</script></body></html>')).alias("html"), vin.alias("expected_vin"))
    photos = G.best_photos(G.photo_candidates(pages.select("url", "html"), gallery=".gallery"))
    cars = pages.select("url", "expected_vin", F.lit(True).alias("identity_proven"), F.lit(2020).alias("year"), F.lit("Ford").alias("make"), F.lit("F150").alias("model")).join(G.declared_photos(pages.select("url", "html")), "url")
    got = G.proven_galleries(photos, cars)
    return pages.select("p_partkey", "url").join(got, "url", "left").select("p_partkey", "proven_by", F.coalesce(F.size("photos"), F.lit(0)).alias("photos"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of twelve vehicle cards; each third page shows one vehicle alone."""
    s = F.col("p_partkey").cast("string")
    card = F.concat(F.lit('<li class="vehicle-card"><div class="inner"><a href="/vdp/'), s, F.lit('-fine-car"><img src="/i.jpg"><b class="year">2020</b></a><a href="/vdp/'), s, F.lit('-fine-car?utm_source=1">More</a></div><i class="price">$ 4,000</i></li>'))
    page = F.floor(F.col("p_partkey") / 12)
    rows = table(spark, sf_dir, "part").withColumn("page_no", page).where((page % 3 != 0) | (F.col("p_partkey") % 12 == 0))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda x: x["c"]), "")
    made = rows.groupBy("page_no").agg(F.concat(F.lit('<html><body><nav><a href="/vdp/1-nav">n</a></nav><main><ul class="cards">'), body, F.lit("</ul></main></body></html>")).alias("html"))
    return made.select("page_no", F.concat(F.lit("https://shop.example.com/used?page="), F.col("page_no").cast("string")).alias("url"), "html")


_PER_PAGE = "SELECT p_partkey // 12 AS page_no, COUNT(*) AS n FROM part WHERE (p_partkey // 12) % 3 <> 0 OR p_partkey % 12 = 0 GROUP BY 1"


@query(f"SELECT CAST(page_no AS BIGINT) AS page_no, 'li.vehicle-card' AS selector, n AS cards, n AS vehicles, 1 AS rank FROM ({_PER_PAGE}) WHERE n > 1")
def card_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selectors of the largest elements that hold one vehicle."""
    pages = _inventory(spark, sf_dir)
    found = C.card_catalogue(C.climbs(pages.select("url", "html"))).join(pages.select("url", "page_no"), "url")
    several = found.where("vehicles > 1")
    return several.select("page_no", "selector", "cards", "vehicles", "rank")


@query(f"SELECT CAST(page_no AS BIGINT) AS page_no, 'li.vehicle-card' AS selector FROM ({_PER_PAGE}) WHERE n = 1")
def single_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _inventory(spark, sf_dir)
    return C.single_card(C.climbs(pages.select("url", "html"))).join(pages.select("url", "page_no"), "url").select("page_no", "selector")


@query(f"SELECT CAST(page_no AS BIGINT) AS page_no, field, selector, n AS cards FROM ({_PER_PAGE}), (VALUES ('year', 'b.year'), ('price', 'i.price')) AS f(field, selector)")
def field_catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of cards that read as fields."""
    pages = _inventory(spark, sf_dir)
    found = C.field_catalogue(C.card_values(pages.select("url", "html"), "li.vehicle-card"))
    return found.join(pages.select("url", "page_no"), "url").select("page_no", "field", "selector", "cards")


@query("SELECT 'sel' || (p_partkey % 10) AS selector FROM part GROUP BY p_partkey % 10 HAVING COUNT_IF(p_partkey % 7 = 3 AND p_partkey < 40) > 0")
def producing_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    link = F.concat(F.lit("https://www.shop.example.com/vdp/"), F.col("p_partkey").cast("string"), F.lit("/"))
    cards = part.select(F.concat(F.lit("sel"), (F.col("p_partkey") % 10).cast("string")).alias("selector"), link.alias("detail_url"))
    wanted = part.where((F.col("p_partkey") % 7 == 3) & (F.col("p_partkey") < 40)).select(F.regexp_replace(link, "www[.]", "").alias("detail_url"))
    return C.producing(cards.select("selector").distinct(), cards, wanted)


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'no_records' END, CASE WHEN o_orderkey % 10 > 8 THEN 'too_many_rejected' END,
  CASE WHEN o_custkey % 2 = 0 AND 3 < o_orderkey % 5 THEN 'total_below_records' END, CASE WHEN o_orderstatus = 'P' THEN 'detail_not_produced' END, CASE WHEN o_orderstatus = 'F' THEN 'identity_not_proven' END,
  CASE WHEN o_custkey % 4 < 2 THEN 'too_few_photos' END, CASE WHEN o_custkey % 3 < 0.8 * (o_custkey % 4) THEN 'not_full_size' END) AS refusals FROM orders""")
def proposal_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    replayed = table(spark, sf_dir, "orders").select("o_orderkey", (o % 5).alias("records"), F.lit(10).alias("raw"), (o % 10).alias("rejected"), F.when(c % 2 == 0, 3).alias("declared"), (F.col("o_orderstatus") != "P").alias("wanted_found"), (F.col("o_orderstatus") != "F").alias("identity_proven"), (c % 4).alias("photos"), (c % 3).alias("full_photos"))
    return replayed.select("o_orderkey", F.array_join(C.refusals(replayed), ",").alias("refusals"))


@query("SELECT 'card' AS kind, 's' || p_size AS selector FROM part WHERE p_size % 3 = 0 GROUP BY p_size")
def unlisted_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.lit("card").alias("kind"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("selector"), "p_size")
    return C.unauthorised(part, part.where("p_size % 3 <> 0"))
