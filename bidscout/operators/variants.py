"""Variants: what a listing says about flavor, shade, size, color, form and model beside the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..functions import text as T

# Words that variants are told apart by.
NEUTRAL_FLAVORS = ("flavorless", "unflavored", "no-flavor", "no flavor", "plain", "natural")
FLAVORS = ("spearmint", "peppermint", "wintergreen", "bubblegum", "bubble gum", "watermelon", "strawberry", "cinnamon", "vanilla", "caramel", "tutti-frutti", "cherry", "grape", "orange", "melon", "berry", "lemon", "cola", "mint")
COLORS = ("teal", "turquoise", "aqua", "lavender", "violet", "magenta", "purple", "pink", "orange", "yellow", "green", "blue", "red", "black", "brown", "gray", "grey")
TOOLS = ("applier", "dispensing gun", "capsule gun", "applicator gun")
MODELS = ("plus", "ultra", "pro", "max", "mini", "lite", "nano", "premier", "select", "classic", "solo", "dual", "extra", "xtra", "xt", "xl", "xs")
SHADE = r"\b([ABCD][1-4](?:\.5)?)\b"
NUMBER = r"(?i)(?:#|\bsize\s+|\bsz\s+|pf171-)(\d{1,2})\b"
SPEED = r"\b(rapid|fast|standard|regular)[\s-]+set\b"
LETTER = r"(?<!\S)([B-HJ-Z])(?!\S)"


def found(x: Column, words: tuple[str, ...]) -> Column:
    """The words that stand in x, as a set."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(rf"\b({'|'.join(words)})\b"), F.lit(1)))


def apart(a: Column, b: Column) -> Column:
    """Both have something, and nothing in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def _has(x: Column, words: tuple[str, ...]) -> Column:
    return F.rlike(F.lower(x), F.lit("|".join(w.replace("-", "[- ]?") for w in words)))


def _same(x: Column, pairs: dict[str, str]) -> Column:
    def one(w: Column) -> Column:
        out = w
        for a, b in pairs.items():
            out = F.when(w == a, F.lit(b)).otherwise(out)
        return out

    return F.array_distinct(F.transform(x, one))


def conflict(ordered: Column, name: Column, url: Column, house_brands: tuple[str, ...] = ()) -> Column:
    """The first kind in which the listing contradicts the order, or null. Silence on either side is no conflict."""
    both = F.concat_ws(" ", name, url)
    first = lambda x, p: F.nullif(F.upper(F.regexp_extract(x, p, 1)), F.lit(""))
    colors = lambda x: _same(found(x, COLORS), {"grey": "gray"})
    speeds = lambda x: _same(F.regexp_extract_all(F.lower(x), F.lit(SPEED), F.lit(1)), {"fast": "rapid", "regular": "standard"})
    letters = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(LETTER), F.lit(1)))
    neutral = lambda x: _has(x, NEUTRAL_FLAVORS)
    flavored = lambda x: _has(x, FLAVORS) & ~neutral(x)
    kit, refill = (lambda x, w=w: F.rlike(F.lower(x), F.lit(rf"\b{w}\b")) for w in ("kit", "refill"))
    models = lambda x: found(x, MODELS)
    house = F.lit(False)
    for b in house_brands:
        house = house | (F.contains(F.lower(ordered), F.lit(b)) & ~F.contains(F.lower(both), F.lit(b)))
    some = lambda a: F.size(a) > 0
    return (
        F.when((neutral(ordered) & flavored(both)) | (flavored(ordered) & neutral(both)), "flavor")
        .when(first(ordered, SHADE) != first(both, SHADE), "shade")
        .when(first(ordered, NUMBER) != first(both, NUMBER), "size")
        .when(apart(colors(ordered), colors(both)), "color")
        .when(_has(name, TOOLS) & ~_has(ordered, TOOLS), "tool")
        .when((kit(ordered) & ~refill(ordered) & refill(both) & ~kit(both)) | (refill(ordered) & ~kit(ordered) & kit(both) & ~refill(both)), "kit or refill")
        .when(house, "house brand")
        .when(apart(speeds(ordered), speeds(both)), "set speed")
        .when(apart(models(ordered), models(both)), "model")
        .when(apart(letters(ordered), letters(both)), "model letter")
        .when((some(letters(ordered)) & some(models(both)) & ~some(models(ordered))) | (some(models(ordered)) & some(letters(both)) & ~some(letters(ordered))), "model")
    )


def flag_conflicts(cands: DataFrame, house_brands: tuple[str, ...] = C.HOUSE_BRANDS) -> DataFrame:
    """conflict_kind and variant_conflict of each candidate; a conflict makes exact approximate, but for a seed's color."""
    kind = conflict(F.concat_ws(" ", "variant", "description"), F.concat_ws(" ", "page_variant", "page_name", "title"), F.col("url"), house_brands)
    df = cands.withColumn("conflict_kind", kind)
    counts = F.col("conflict_kind").isNotNull() & ~(R.true("is_seed") & (F.col("conflict_kind") == "color"))
    counts = F.coalesce(counts, F.lit(False))
    return df.withColumn("variant_conflict", R.true("variant_conflict") | counts).withColumn("match_type", F.when(counts & (F.col("match_type") == "exact"), "approximate").otherwise(F.col("match_type")))


# How headings state packs, garment sizes and the body of a material, and words that don't name a product.
HEAD = r"(?m)^#\s+(.{10,200})$"
HEAD_PACK = r"(?i)\b(\d{1,5})\s*(?:/\s*|-|\s+per\s+|\s+)(?:box|bx|pk|pack|pkg|count|ct|can|cn|case|ca|carton)\b|\b(\d{1,4})\s*[x×]\s*\d+(?:\.\d+)?\s*(?:ml|mls|cc|g|gr|gm|oz|lb|l)\b"
SIZE_WORD = r"(?i)\b(x-?small|x-?large|small|medium|large)\b"
SIZE_LETTER = r"\b(XS|XL|S|M|L)\b"
SIZES = {"xsmall": "xs", "small": "s", "medium": "m", "large": "l", "xlarge": "xl"}
BODY = r"(?i)\b(x-?light|extra\s+light|xlight|light|medium|heavy|mono(?:phase)?)\s+bod(?:y|ied)\b|\bputty\b"
BODIES = {"": "putty", "extralight": "xlight", "mono": "monophase"}
PACK_WORDS = ("bx", "pk", "bg", "ea", "bt", "box", "pack", "bag", "each", "bottle", "refill", "kit", "syringe")
KIND_WORDS = ("universal", "dental", "adhesive", "bond", "bonding", "cement", "material", "composite", "impression", "tray", "mixing", "tips", "medium", "fine", "light", "heavy", "body", "clear", "white", "opaque", "anterior", "posterior")
SMALL_WORDS = ("the", "and", "for", "with")


def sizes(x: Column) -> Column:
    """The garment sizes that a text states: words in any case, letters in upper case."""
    words = _same(F.transform(F.regexp_extract_all(x, F.lit(SIZE_WORD), F.lit(1)), lambda w: F.replace(F.lower(w), F.lit("-"))), SIZES)
    return F.array_union(words, F.transform(F.regexp_extract_all(x, F.lit(SIZE_LETTER), F.lit(1)), F.lower))


def bodies(x: Column) -> Column:
    """The bodies (viscosities) that a text states."""
    return _same(F.transform(F.regexp_extract_all(x, F.lit(BODY), F.lit(1)), lambda w: F.regexp_replace(F.lower(w), r"[\s-]", "")), BODIES)


def confirm_by_heading(cands: DataFrame) -> DataFrame:
    """A page's heading, or its structured name, that states the ordered pack, most of the ordered words and every
    identifier, and contradicts nothing, confirms name, size and pack.

    Identifiers are words of three characters or more with a digit, dimensions (6x6) aside; those of the description
    may be in the url. Of a branded product with a name, a word that is its own must be there.
    """
    cands = cands.withColumns({k: F.lit(None).cast("string") for k in ("structured_name", "product_name") if k not in cands.columns})
    words = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9.]+"), F.lit(0))
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    head = F.coalesce(F.nullif(F.trim(F.regexp_extract("page_text", HEAD, 1)), F.lit("")), F.nullif(F.col("structured_name"), F.lit("")))
    # what is read for each word of a line is a column, so that it is made once for a page
    cands = cands.withColumn("heading", head)
    head = F.col("heading")
    name_words = words(F.col("product_name"))
    cands = cands.withColumns({"_page": F.lower(head), "_brand": words(F.col("brand")), "_plain": plain(head), "_place": plain(F.concat_ws(" ", head, "url"))})
    page, brand = F.col("_page"), F.col("_brand")
    pack = F.coalesce(*(T.number(F.regexp_extract(head, HEAD_PACK, k), "int") for k in (1, 2)))
    there = lambda t: F.contains(page, t) | (F.endswith(t, F.lit("s")) & F.contains(page, F.substring(t, F.lit(1), F.length(t) - 1)))
    cands = cands.withColumn("_wanted", F.filter(words(F.concat_ws(" ", "product_name", "description")), lambda t: (F.length(t) > 2) & ~F.array_contains(brand, t)))
    wanted = F.col("_wanted")
    share = F.try_divide(F.size(F.filter(wanted, there)), F.size(wanted))
    ids = lambda tokens: F.filter(F.transform(tokens, plain), lambda t: (F.length(t) >= 3) & F.rlike(t, F.lit(r"\d")) & ~F.rlike(t, F.lit("^[0-9x]*x[0-9x]*$")))
    ordered = F.concat_ws(" ", "variant", "description")
    named = F.forall(ids(wanted), lambda t: F.contains(F.col("_plain"), t)) & F.forall(ids(words(F.concat_ws(" ", "description", "variant"))), lambda t: F.contains(F.col("_place"), t))
    common = F.array(*(F.lit(w) for w in (*PACK_WORDS, *KIND_WORDS, *SMALL_WORDS)))
    own = F.filter(name_words, lambda t: (F.length(t) > 1) & ~F.array_contains(brand, t) & ~F.array_contains(common, t))
    anchored = (F.coalesce("brand", F.lit("")) == "") | (F.size(own) == 0) | F.exists(own, there)
    against = apart(sizes(ordered), sizes(head)) | apart(bodies(ordered), bodies(head)) | conflict(ordered, head, F.lit("")).isNotNull()
    judged = R.true("name_match") & R.true("size_form_match") & R.true("pack_match")
    ok = F.col("price").isNotNull() & ~R.true("variant_conflict") & ~judged & (pack == F.nullif(F.col("ordered_pack"), F.lit(0))) & (share >= C.TOKEN_OVERLAP) & named & anchored & ~against
    df = cands.withColumn("heading_pack", pack).withColumn("heading_confirms", F.coalesce(ok, F.lit(False)))
    sure = F.col("heading_confirms")
    structured = F.coalesce("price_structured", F.lit(False)) if "price_structured" in cands.columns else F.lit(False)
    open_ = (~R.gated() | structured) & ~R.says("sanity") & ~R.dead() & ~R.says("out of stock")
    opened = sure & open_ & (F.col("match_type") == "rejected")
    has_brand = F.contains(F.lower("heading"), F.lower(F.coalesce("brand", F.lit(""))))
    return df.withColumns(
        {
            "page_name": F.when(sure, F.coalesce("page_name", "heading")).otherwise(F.col("page_name")),
            "pack_qty": F.when(sure, F.coalesce("pack_qty", "heading_pack")).otherwise(F.col("pack_qty")),
            "brand_match": F.when(sure & has_brand, F.lit(True)).otherwise(F.col("brand_match")),
            **{c: F.when(sure, F.lit(True)).otherwise(F.col(c)) for c in ("name_match", "size_form_match", "pack_match")},
            "rejected_reason": F.when(opened, F.lit(None).cast("string")).otherwise(F.col("rejected_reason")),
            "match_type": F.when(opened, "approximate").otherwise(F.col("match_type")),
        }
    ).drop("heading", "heading_pack", "_page", "_brand", "_plain", "_place", "_wanted")


USED = r"(?i)\b(?:used|open box|refurbished|for parts|pre-owned)\b"
NEW = r"(?i)\b(?:brand new|new)\b"


def condition_gate(cands: DataFrame) -> DataFrame:
    """Marketplace listings must be new and for a fixed price: the listing's own condition first, its text second, unread pages pass."""
    said = F.nullif(F.trim("condition"), F.lit(""))
    text = F.coalesce("page_text", F.lit(""))
    auction = F.rlike(text, F.lit(r"(?i)\b(?:current bid|place bid|\d+ bids?)\b")) & ~F.rlike(text, F.lit(r"(?i)buy it now"))
    why = (
        F.when(said.isNotNull(), F.when(F.rlike(said, F.lit(USED)), "not new").when(~F.rlike(said, F.lit(NEW)), "condition not confirmed"))
        .when(text == "", F.lit(None).cast("string"))
        .when(F.rlike(text, F.lit(USED)), "not new")
        .when(~F.rlike(text, F.lit(NEW)), "condition not confirmed")
        .when(auction, "auction without a fixed price")
    )
    df = cands.withColumn("condition_reason", F.when(F.col("marketplace").isNotNull(), why))
    return df.withColumn("match_type", F.when(F.col("condition_reason").isNotNull(), "rejected").otherwise(F.col("match_type"))).withColumn("rejected_reason", F.coalesce("condition_reason", "rejected_reason"))


def match_title(cands: DataFrame) -> DataFrame:
    """Criteria of a marketplace hit from its title and url alone: multi-packs first, most of the ordered words, brand, shade."""
    # what is read for each word of a line is a column, so that it is made once for a hit
    cands = cands.withColumns({"_title": F.lower(F.coalesce("title", F.lit(""))), "_brand": T.tokens(F.col("brand"))})
    title, brand = F.col("_title"), F.col("_brand")
    hay = F.concat_ws(" ", "title", "url")
    number = lambda p: T.number(F.regexp_extract(hay, p, 1), "int")
    pack = F.coalesce("pack_qty", number(r"(?i)pack[\s-]+of[\s-]+(\d{1,5})"), number(r"(?i)\b(\d{1,5})[\s-]*pack\b"), number(HEAD_PACK), T.number(F.regexp_extract(hay, HEAD_PACK, 2), "int"), number(r"(?i)\b(\d{1,5})\s*(?:capsules?|pcs|pieces)\b"))
    cands = cands.withColumn("_wanted", F.filter(T.tokens(F.concat_ws(" ", "description", "variant"), 2), lambda t: ~F.array_contains(brand, t)))
    wanted = F.col("_wanted")
    named = F.coalesce(T.overlap(wanted, title) >= C.TOKEN_OVERLAP, F.lit(False))
    kind = F.when(named, conflict(F.concat_ws(" ", "variant", "description"), F.col("title"), F.col("url")))
    shade = F.regexp_extract(F.lower(F.coalesce("variant", F.lit(""))), r"\b[ab]\d(?:\.\d)?\b", 0)
    no_shade = (shade != "") & ~F.rlike(title, F.lit(r"\b[ab]\d(?:\.\d)?\b"))
    seed = R.true("is_seed")
    ok = seed | (named & kind.isNull() & ~no_shade)
    return (
        cands.withColumn("pack_qty", pack)
        .withColumn("brand_match", seed | (F.coalesce("brand", F.lit("")) == "") | F.contains(title, F.get(F.split(F.lower("brand"), " "), 0)))
        .withColumn("name_match", ok)
        .withColumn("pack_match", F.coalesce((seed & F.col("pack_qty").isNull()) | (F.col("pack_qty") == F.col("ordered_pack")), F.lit(False)))
        .withColumn("match_type", F.when(ok, "approximate").otherwise("rejected"))
        .drop("_title", "_brand", "_wanted")
    )
