"""Predicates and labels of a candidate listing beside its order line, as Columns.

They read the columns of `candidates`: price, unit_price, pack_qty, ordered_pack,
match_type, the four criteria (null: not judged), and the flags.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from . import text as T

#: Columns don't change, so a rule is built once; each of its parts is a call to the JVM.
rule = functools.cache
c = functools.cache(F.col)


@rule
def true(name: str) -> Column:
    """The flag is set; a missing one isn't."""
    return F.coalesce(c(name), F.lit(False))


@rule
def not_false(name: str) -> Column:
    """The flag isn't denied; a missing one is fine."""
    return F.coalesce(c(name), F.lit(True))


@rule
def sane_price(low: float = C.SANE_LOW, high: float = C.SANE_HIGH) -> Column:
    ok = (c("price") > 0) & (c("price") >= c("unit_price") * low) & (c("price") <= c("unit_price") * high)
    return F.coalesce(ok, F.lit(False))


@rule
def pack_compat() -> Column:
    """null if either pack is unknown."""
    return c("pack_qty") == c("ordered_pack")


@rule
def says(word: str) -> Column:
    return F.coalesce(F.contains(F.lower("rejected_reason"), F.lit(word)), F.lit(False))


@rule
def gated() -> Column:
    return says("login")


@rule
def dead() -> Column:
    return says("page not found")


@rule
def reviewable() -> Column:
    return c("price").isNotNull() & ~gated() & ~says("sanity")


@rule
def brand_confirmed() -> Column:
    """As reports take it: matched, or the line has no brand."""
    return true("brand_match") | (F.coalesce(c("brand"), F.lit("")) == "")


@rule
def pack_mismatch() -> Column:
    known = F.coalesce((c("pack_qty") != 0) & (c("ordered_pack") != 0) & ~pack_compat(), F.lit(False))
    return ~not_false("pack_match") | known


@rule
def exact_candidate() -> Column:
    return true("name_match") & true("size_form_match") & true("pack_match") & brand_confirmed()


def effective_exact(volume: Column | None = None) -> Column:
    """Confirmed by number, or by its criteria; lenient on brand if the rest is sure, on size for locked prices."""
    volume_ok = F.lit(True) if volume is None else F.coalesce(volume, F.lit(True))
    by_number = true("mpn_confirmed") & ~true("variant_conflict") & F.coalesce(pack_compat(), F.lit(True))
    size_ok = true("size_form_match") | (true("price_locked") & true("name_match") & true("pack_match") & volume_ok)
    brand_ok = brand_confirmed() | (true("name_match") & true("size_form_match") & true("pack_match"))
    return by_number | (true("name_match") & size_ok & true("pack_match") & brand_ok)


@rule
def bulk_value() -> Column:
    """A larger pack of the same product for less money."""
    known = (c("pack_qty") > 0) & (c("ordered_pack") > 0) & (c("price") > 0) & (c("unit_price") > 0)
    better = (c("pack_qty") > c("ordered_pack")) & (c("price") < c("unit_price"))
    bad = gated() | true("out_of_stock") | true("price_unreliable") | true("variant_conflict") | (c("match_type") == "unverified")
    same = true("mpn_confirmed") | (true("name_match") & true("size_form_match"))
    brand = brand_confirmed() | true("mpn_confirmed")
    return F.coalesce(known & better, F.lit(False)) & ~bad & same & brand


@rule
def price_match_eligible() -> Column:
    ready = c("price").isNotNull() & c("page_name").isNotNull() & ~true("price_unreliable") & ~true("out_of_stock") & sane_price() & ~gated()
    by_criteria = ~true("variant_unverified") & true("name_match") & true("size_form_match") & true("pack_match")
    like_for_like = ~pack_mismatch() & ~dead() & ~true("variant_conflict") & (true("mpn_confirmed") | by_criteria)
    return ready & (bulk_value() | like_for_like)


@rule
def pack_conflict() -> Column:
    """Packs differ by a factor of three or more."""
    big, small = F.greatest("pack_qty", "ordered_pack"), F.least("pack_qty", "ordered_pack")
    return F.coalesce((small > 0) & (big >= C.PACK_CONFLICT_RATIO * small) & c("pack_qty").isNotNull() & c("ordered_pack").isNotNull(), F.lit(False))


@rule
def poolable(savings_only: bool = True) -> Column:
    """May be shown as an option."""
    strong = c("match_type").isin("exact", "approximate") | true("mpn_confirmed")
    floor = F.when(strong, c("unit_price") * C.SANE_LOW).otherwise(c("unit_price") * C.WEAK_FLOOR)
    priced = c("price").isNotNull() & (c("price") >= floor) & (c("price") <= c("unit_price") * C.SANE_HIGH)
    if savings_only:
        priced = priced & (c("price") < c("unit_price"))
    barred = gated() | true("out_of_stock") | true("variant_conflict") | pack_conflict() | c("match_type").isin("rejected", "unverified") | dead()
    return F.coalesce(priced, F.lit(False)) & c("page_name").isNotNull() & ~barred


@rule
def option_tier() -> Column:
    """0 eligible, 1 pack and variant match, 2 pack matches, 3 the rest; unreliable or unavailable ones 2 at best."""
    variant_ok = ~true("variant_unverified") & not_false("name_match")
    tier = F.when(price_match_eligible(), 0).when(~pack_mismatch() & variant_ok, 1).when(~pack_mismatch(), 2).otherwise(3)
    return F.when(true("price_unreliable") | true("out_of_stock"), F.greatest(tier, F.lit(2))).otherwise(tier)


@rule
def criteria_met() -> Column:
    return sum((true(k).cast("int") for k in ("name_match", "size_form_match", "pack_match")), true("brand_match").cast("int"))


@rule
def match_score() -> Column:
    return F.round(criteria_met() * 15 + F.coalesce("confidence", F.lit(0)) * F.lit(0.4)).cast("int")


@rule
def score_label() -> Column:
    """The first label that holds, with the score."""
    with_score = lambda label: F.format_string(f"{label} (%d%%)", match_score())
    unjudged = c("name_match").isNull() & c("brand_match").isNull() & c("size_form_match").isNull() & c("pack_match").isNull()
    return (
        F.when(true("out_of_stock"), with_score("OUT OF STOCK"))
        .when(gated(), with_score("GATED"))
        .when(true("price_unreliable"), with_score("UNVERIFIED PRICE"))
        .when(generic_tag(), with_score("GENERIC EQUIVALENT"))
        .when(bulk_value(), with_score("BULK VALUE"))
        .when((c("match_type") == "unverified") & unjudged & c("price").isNotNull(), F.lit("UNVERIFIED"))
        .when(exact_candidate() & true("variant_unverified"), with_score("EXACT · VARIANT UNVERIFIED"))
        .when(exact_candidate(), with_score("EXACT"))
        .when(c("match_type").isin("exact", "approximate"), with_score("APPROXIMATE"))
        .otherwise(with_score("POSSIBLE"))
    )


@rule
def generic_tag() -> Column:
    """Same product, size and pack under another brand."""
    return true("name_match") & true("size_form_match") & true("pack_match") & ~true("brand_match") & (F.coalesce(c("brand"), F.lit("")) != "")


@rule
def mismatch_reason() -> Column:
    """Why a candidate isn't in the price-match report."""
    pack = F.coalesce(F.nullif(c("pack_qty"), F.lit(0)).cast("string"), F.lit("?"))
    ordered = F.coalesce(F.nullif(c("ordered_pack"), F.lit(0)).cast("string"), F.lit("?"))
    return F.concat_ws(
        " · ",
        F.when(pack_mismatch(), F.concat(F.lit("PACK MISMATCH (page "), pack, F.lit(" vs ordered "), ordered, F.lit(")"))),
        F.when(~not_false("size_form_match"), "SIZE/VOLUME MISMATCH"),
        F.when(true("variant_unverified") | ~not_false("name_match"), F.concat(F.lit("VARIANT MISMATCH (ordered: "), F.coalesce("variant", F.lit("specified")), F.lit(")"))),
        F.when(gated(), "LOGIN-GATED price"),
        F.when(dead(), "DEAD/EXPIRED listing"),
    )


@rule
def marketplace_eligible() -> Column:
    return price_match_eligible() & (brand_confirmed() | true("mpn_confirmed"))


@rule
def house_brand() -> Column:
    """The line is of a house brand, which nobody else sells."""
    low = F.lower(F.coalesce(c("brand"), F.lit("")))
    return functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in C.HOUSE_BRANDS), F.lit(False))


@rule
def generic_eligible() -> Column:
    """For house brands: another product of the same kind, grade and pack at a sane price, whatever its name and brand.

    The pack is the listing's, or one that its name or url states. All grades of the
    description (#2) and most of its words must be in the listing's name.
    """
    name = F.coalesce(*(F.nullif(c(k), F.lit("")) for k in ("page_name", "title", "structured_name")))
    stated = T.number(F.regexp_extract(F.concat_ws(" ", name, c("url")), C.STATED_PACK, 1), "int")
    pack = F.coalesce(F.coalesce(c("pack_qty"), stated) == F.nullif(c("ordered_pack"), F.lit(0)), F.lit(False))
    barred = gated() | true("out_of_stock") | true("price_unreliable")
    page, ordered = F.lower(F.concat_ws(" ", name, c("title"))), F.lower(F.coalesce(c("description"), F.lit("")))
    close = lambda x: F.regexp_replace(x, r"\s", "")
    grades = F.forall(F.regexp_extract_all(ordered, F.lit(r"#\s*\d+"), F.lit(0)), lambda g: F.contains(close(page), close(g)))
    stop = F.array(*(F.lit(w) for w in (*C.GENERIC_STOP, *" ".join(C.HOUSE_BRANDS).split())))
    tokens = F.filter(F.regexp_extract_all(ordered, F.lit("[a-z0-9#]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))
    words = F.filter(tokens, lambda t: F.rlike(t, F.lit("^[a-z]+$")))
    share = lambda found: F.try_divide(F.size(F.filter(found, lambda t: F.contains(page, t))), F.size(found))
    alike = F.coalesce(share(words) >= C.GENERIC_WORDS, F.lit(True)) & F.coalesce(share(tokens) >= C.GENERIC_TOKENS, F.lit(False))
    return name.isNotNull() & sane_price() & ~barred & pack & grades & alike


def savings_band(pct: Column) -> Column:
    return F.when(pct > 10, "green").when(pct >= 5, "yellow")


def upper_median(values: Column) -> Column:
    """The value at place n // 2 (from 0) of the sorted array; null for an empty one."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))
