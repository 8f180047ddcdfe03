"""Text, number and keyword functions as Column expressions; nothing here needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import _let

#: Fixed value: the sentinel texts by which a seller withholds a price.
PRICE_WITHHELD = r"(?i)call\s+(?:us\s+)?for\s+(?:price|pricing|details)|please\s+call|contact\s+(?:us|dealer)\s+for\s+(?:price|pricing)|price\s+not\s+available"
#: Fixed value: words that tell of a vehicle.
VEHICLE_WORDS = (
    r"(?i)\b(?:new|used|certified|vehicle|sedan|coupe|suv|truck|van|wagon|toyota|honda|ford|chevrolet|nissan|jeep|kia|hyundai|subaru|mazda|"
    r"volkswagen|bmw|mercedes|audi|lexus|acura|ram|gmc|buick|cadillac)\b"
)
#: Fixed value: what looks like a secret.
SECRET = r"(?i)(?:\bBearer\s+[A-Za-z0-9._~-]{12,}|\bsk-(?:proj-)?[A-Za-z0-9_-]{12,}|\b(?:api[_-]?key|access[_-]?token|client[_-]?secret|password|passwd|authorization|set-cookie)\b\s*[=:])"
CURRENCY = r"(?i)(?:[$£€¥]\s?\d|\d[\d,.]*\s?(?:USD|CAD|EUR|GBP))"
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"


def clean_text(c: Column, limit: int | None = None) -> Column:
    """White space runs made one blank, ends trimmed; null if nothing is left."""
    t = _let(F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")), lambda x: F.when(x != "", x))
    return t if limit is None else F.substring(t, 1, limit)


def is_blank(c: Column, kind: str = "string") -> Column:
    """Null, the empty text or the empty list; 0 and false are no blanks."""
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def coalesce_blank(first: Column, second: Column, kind: str = "string") -> Column:
    return F.when(is_blank(first, kind), second).otherwise(first)


def number(c: Column) -> Column:
    """The first number of a text, commas dropped; null if negative or not a number."""
    token = F.replace(F.regexp_extract(clean_text(c), r"-?\d[\d,.]*", 0), F.lit(","), F.lit(""))
    return _let(token.try_cast("double"), lambda n: F.when(n >= 0, n))


def integer(c: Column) -> Column:
    return number(c).cast("bigint")


def plain_number(c: Column) -> Column:
    """A text that is a number but for commas and dollar signs."""
    return F.trim(F.regexp_replace(c, "[,$]", "")).try_cast("double")


def year(c: Column) -> Column:
    return F.regexp_extract(clean_text(c), YEAR, 1).try_cast("int")


def unit(c: Column) -> Column:
    read = lambda t: F.when(t.rlike(r"\b(?:km|kilomet(?:er|re)s?)\b"), "km").when(t.rlike(r"\b(?:mi|mile|miles)\b"), "mi")
    return _let(F.lower(clean_text(c)), read)


def condition(c: Column) -> Column:

    def read(t: Column) -> Column:
        used = t.contains("used")
        return F.when(t.contains("certified") | t.contains("cpo"), "certified").when(t.contains("new") & ~used, "new").when(used | t.contains("pre-owned") | t.contains("preowned"), "used")

    return _let(F.lower(clean_text(c)), read)


def price_withheld(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(PRICE_WITHHELD)


def positive(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def usable_price(price: Column, model_year: Column) -> Column:
    """A price above zero that is not the row's own model year."""
    return F.when(positive(price) & ~F.coalesce((price == model_year) & model_year.between(1900, 2100), F.lit(False)), price)


def card_mileage(c: Column) -> Column:
    """(mileage, unit) if a card names exactly one odometer reading."""
    spans = F.regexp_extract_all(F.coalesce(clean_text(c, 8000), F.lit("")), F.lit(r"(?i)(?<![\d.])(\d[\d,]*(?:\.\d+)?\s*(?:km|kilomet(?:er|re)s?|mi|miles?))(?![a-z])"), 1)
    found = F.array_distinct(
        F.transform(
            spans,
            lambda s: F.struct(
                F.replace(F.regexp_extract(s, r"\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit("")).cast("double").alias("mileage"),
                F.lower(F.regexp_extract(s, r"[A-Za-z]+$", 0)).alias("word"),
            ),
        )
    )
    one = F.get(found, F.lit(0))
    short = F.lower(one["word"])
    return F.when(F.size(found) == 1, F.struct(one["mileage"].alias("mileage"), F.when(short.startswith("km") | short.startswith("kilo"), "km").otherwise("mi").alias("unit")))


def _single(found: Column) -> Column:
    d = F.array_distinct(found)
    return F.when(F.size(d) == 1, F.get(d, F.lit(0)))


def card_stock(c: Column) -> Column:
    """The stock number if a card names exactly one."""
    spans = F.regexp_extract_all(F.coalesce(clean_text(c, 8000), F.lit("")), F.lit(r"(?i)\b(?:stk|stock)(?:\s*(?:number|no\.?))?\s*#?\s*[:=-]?\s*([A-Z0-9][A-Z0-9._/-]{1,39})\b"), 1)
    return _single(F.transform(spans, lambda x: F.upper(x)))


def card_engine(c: Column) -> Column:
    """The engine if a card names exactly one."""
    spans = F.regexp_extract_all(F.coalesce(clean_text(c, 8000), F.lit("")), F.lit(r"(?i)\b(\d(?:\.\d+)?\s*L(?:\s+(?:\d+\s*cyl(?:inder)?s?|[A-Z0-9-]+))?)\b"), 1)
    return _single(F.transform(spans, lambda x: clean_text(x)))


def declared_total(c: Column) -> Column:
    """The size that a result line states: labelled counts, else the number after 'of', else the largest number."""
    t = clean_text(c)
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    numbers = lambda found: F.transform(F.filter(F.transform(found, digits), lambda d: d != ""), lambda d: d.cast("bigint"))
    labelled = numbers(F.regexp_extract_all(t, F.lit(r"(?i)(\d[\d\s,.]*)\s+(?:vehicles?|cars?|results?|matches?|v[ée]hicules?|voitures?|autos?|veh[ií]culos?|coches?)\b"), 1))
    bare = F.regexp_replace(t, r"(?i)\bpages?\s+\d+\s+(?:of|sur|de)\s+\d[\d\s,.]*", " ")
    of = numbers(F.regexp_extract_all(bare, F.lit(r"(?i)\b(?:of|sur)\s+(\d[\d\s,.]*)"), 1))
    de = numbers(F.regexp_extract_all(bare, F.lit(r"(?i)\b\d+\s*(?:[-–]|a)\s*\d+\s+de\s+(\d[\d\s,.]*)"), 1))
    any_ = numbers(F.regexp_extract_all(bare, F.lit(r"(\d[\d,]*)"), 1))
    last = lambda a: F.get(a, F.size(a) - 1)
    return F.when(F.size(labelled) > 0, F.array_max(labelled)).when(F.size(of) > 0, last(of)).when(F.size(de) > 0, last(de)).otherwise(F.array_max(any_))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(s, 1, 64)


def field_name(c: Column) -> Column:
    """Snake case of at most 48 characters; null if it does not begin with a letter."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(n.rlike("^[a-z][a-z0-9_]{0,47}$"), n)


def tokens(c: Column) -> Column:
    """Lower-case words and, of longer ones in s, the singular."""
    words = F.regexp_extract_all(F.replace(F.lower(c), F.lit("pre-owned"), F.lit("preowned")), F.lit("[a-z0-9]+"), 0)
    return F.array_union(words, F.transform(F.filter(words, lambda w: (F.length(w) > 3) & w.endswith("s")), lambda w: F.substr(w, F.lit(1), F.length(w) - 1)))


def spreadsheet_safe(c: Column) -> Column:
    """A text that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def secret_shaped(c: Column) -> Column:
    return c.rlike(SECRET)


def redact(c: Column) -> Column:
    return F.regexp_replace(c, SECRET, "[redacted]")


def unique_folded(c: Column, cap: int) -> Column:
    """The first of each text but for case and outer blanks, at most cap of them."""
    kept = F.aggregate(
        c,
        F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("values")),
        lambda s, x: F.when(
            (F.trim(x) != "") & ~F.array_contains(s["keys"], F.lower(F.trim(x))),
            F.struct(F.array_append(s["keys"], F.lower(F.trim(x))).alias("keys"), F.array_append(s["values"], x).alias("values")),
        ).otherwise(s),
        lambda s: s["values"],
    )
    return F.slice(kept, 1, cap)


def comparable(c: Column, numeric: bool) -> Column:
    """Values as two sources compare them: numbers rounded half-even to integers, texts folded."""
    if numeric:
        return F.bround(c, 0).cast("bigint").cast("string")
    t = F.lower(F.trim(c))
    return F.when(t != "", t)
