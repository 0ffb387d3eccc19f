"""Strength units and pack notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical units with the factor to them, their spellings, and words in pack notations.
SPELLINGS = {
    ("mg", 1.0): ("mg", "mgs", "milligram", "milligrams"),
    ("mg", 1000.0): ("g", "gm", "gms", "gram", "grams"),
    ("mcg", 1.0): ("mcg", "ug", "\u00b5g", "\u03bcg", "microgram", "micrograms"),
    ("ml", 1.0): ("ml", "millilitre", "milliliter", "cc"),
    ("ml", 1000.0): ("l", "litre", "liter"),
    ("IU", 1.0): ("iu", "units", "unit", "u"),
    ("%", 1.0): ("%", "percent"),
}
UNITS = {word: base for base, words in SPELLINGS.items() for word in words}
COUNTED = ("tab", "tabs", "tablet", "tablets", "cap", "caps", "capsule", "capsules", "t", "tb", "c", "pcs", "pc", "piece", "pieces", "nos", "no", "s")
CONTAINERS = ("vial", "tube", "bottle", "ampoule", "ampule", "pen", "jar", "sachet", "inhaler", "kit")


def normalise_strength(value: Column, unit: Column) -> Column:
    """struct(value, unit) in mg, mcg, ml, IU or %; an unknown unit becomes null and the value stays."""
    key = F.replace(F.lower(F.trim(unit)), F.lit("."), F.lit(""))
    names = F.create_map(*(F.lit(x) for k, v in UNITS.items() for x in (k, v[0])))
    factors = F.create_map(*(F.lit(x) for k, v in UNITS.items() for x in (k, v[1])))
    return F.struct((value * F.coalesce(F.try_element_at(factors, key), F.lit(1.0))).alias("value"), F.try_element_at(names, key).alias("unit"))


def pack_size(raw: Column) -> Column:
    """struct(method, units, volume) of a pack notation; the first form that fits counts, volumes before counts. Blank is null."""
    text = F.trim(F.regexp_replace(F.lower(raw), r"\s+", " "))
    number = lambda pattern, group=1: F.regexp_extract(text, pattern, group).try_cast("int")
    # fixed values: the notations
    volume, strip, times, each, word = r"^(\d+(?:\.\d+)?) ?(ml|l)\b", r"^(?:strip|pack|box|blister) of (\d+)$", r"^(\d+) ?[x×*] ?(\d+)$", r"^(\d+) ?'? ?s$", r"^(\d+) ?([a-z]+)$"
    named = F.regexp_extract(text, word, 2)
    method = F.when(text.rlike(volume), "volume").when(text.rlike(strip), "strip_of").when(text.rlike(times), "multiplier").when(text.rlike(each), "apostrophe_s").when(named.isin(*COUNTED), "count_unit").when(named.isin(*CONTAINERS), "singular").otherwise("unrecognised")
    units = F.when(method == "strip_of", number(strip)).when(method == "multiplier", number(times) * number(times, 2)).when(method == "apostrophe_s", number(each)).when(method.isin("count_unit", "singular"), number(word))
    litres = F.regexp_extract(text, volume, 2) == "l"
    millilitres = F.when(method == "volume", F.regexp_extract(text, volume, 1).try_cast("double") * F.when(litres, 1000.0).otherwise(1.0))
    return F.when(F.length(text) > 0, F.struct(method.alias("method"), units.alias("units"), millilitres.alias("volume")))


def parse_strengths(raw: Column) -> Column:
    """array(struct(value, unit)) of a strength as written, combinations joined by plus or slash; the last known unit serves the parts without one."""
    read = F.filter(F.split(F.coalesce(raw, F.lit("")), r"[+/]"), lambda p: p.rlike("[0-9]"))
    part = r"(\d+(?:\.\d+)?)\s*(%|[a-zA-Z\u00b5\u03bc]*)"
    known = F.create_map(*(F.lit(x) for word in UNITS for x in (word, word)))
    unit = lambda p: F.try_element_at(known, F.lower(F.regexp_extract(p, part, 2)))
    last = F.try_element_at(F.filter(F.transform(read, unit), lambda u: u.isNotNull()), F.lit(-1))
    return F.transform(read, lambda p: normalise_strength(F.regexp_extract(p, part, 1).try_cast("double"), F.coalesce(unit(p), last)))


#: Share by which amounts may differ that are to be the same.
PRICE_TOLERANCE = 0.02


def units_basis(declared: Column, quantity: Column, price: Column, total: Column, per_pack: Column) -> Column:
    """struct(basis, method): whether a quantity counts packs or units, as declared or as only the price of units in packs explains the total."""
    amount, stated = total.cast("double"), quantity * price.cast("double")
    close = lambda a: F.abs(a - amount) <= PRICE_TOLERANCE * F.greatest(F.abs(a), F.abs(amount), F.lit(1.0))
    known = quantity.isNotNull() & price.isNotNull() & total.isNotNull() & per_pack.isNotNull()
    proved = known & close(stated * per_pack) & ~close(stated)
    basis = F.when(declared.isNotNull(), declared).when(proved, "pack")
    method = F.when(declared.isNotNull(), "declared").when(~known, "no_price_data").when(proved, "price_reconciled").otherwise("price_inconclusive")
    return F.struct(basis.alias("basis"), method.alias("method"))


def clamp_unit(value: Column) -> Column:
    """Between 0 and 1; null is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def valid_box(box: Column) -> Column:
    """Whether a box has four sides within 0 and 1 and isn't inverted or flat."""
    side = lambda k: F.get(box, F.lit(k))
    return F.coalesce((F.size(box) == 4) & F.forall(box, lambda x: x.between(0.0, 1.0)) & (side(2) > side(0)) & (side(3) > side(1)), F.lit(False))


def shaky(agreement: Column) -> Column:
    """The fields of a map of agreements on which the runs differed."""
    return F.map_filter(agreement, lambda _, x: x < 1.0)


def bar_segments(annual: Column, used: Column, claim: Column) -> Column:
    """struct(used, claim) as hundredths of the allowance, both together 100 at most."""
    share = lambda x: F.try_divide(x.cast("double") * 100, annual.cast("double"))
    drawn = F.least(F.lit(100.0), share(used))
    added = F.greatest(F.lit(0.0), F.least(share(claim), 100 - drawn))
    some = annual.cast("double") > 0
    return F.struct(F.when(some, drawn).otherwise(0.0).alias("used"), F.when(some, added).otherwise(0.0).alias("claim"))
