"""Column functions for messy grid attributes: voltages, capacities, fuels, operators, names.

All are built-in expressions (inside whole-stage code generation); text is parsed to a number only
behind a pattern, so that forms which engines read differently give null.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, functions as F

NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Voltage classes in kV and their tolerance brackets, fuel names, operator names.
VOLTAGE_CLASSES = [500.0, 275.0, 220.0, 187.0, 154.0, 132.0, 110.0, 77.0, 66.0]
BRACKETS = [500.0, 275.0, 220.0, 187.0, 154.0, 132.0, 110.0, 77.0, 66.0, 33.0, 22.0, 6.6]
# Fuel names of tags, of complementary lists and of the network model; keywords of names in order of precedence.
FUEL_TAGS = {"coal": "coal", "gas": "gas", "natural_gas": "gas", "oil": "oil", "nuclear": "nuclear", "hydro": "hydro", "water": "hydro", "wind": "wind", "solar": "solar", "photovoltaic": "solar", "biomass": "biomass", "biogas": "biomass", "waste": "waste", "geothermal": "geothermal", "tidal": "tidal", "wave": "tidal", "battery": "battery", "pumped_storage": "pumped_hydro", "diesel": "oil"}
FUEL_LISTS = {"solar": "solar", "hydro": "hydro", "nuclear": "nuclear", "coal": "coal", "gas": "gas", "wind": "wind", "biomass": "biomass", "oil": "oil", "geothermal": "geothermal", "waste": "waste", "tidal": "tidal", "pumped_hydro": "pumped_hydro", "battery": "battery", "oil;gas": "oil", "waste;solar": "waste"}
FUEL_MODEL = {"gas": "lng", "natural_gas": "lng", "waste": "biomass", "biofuel": "biomass", "battery": "unknown", "bing": "unknown", "gsimaps/ort": "unknown", "image": "unknown", "biomass_waste": "biomass"}
FUEL_KEYWORDS = [("nuclear", ["nuclear", "原子力", "原発"]), ("coal", ["coal", "石炭", "火力"]), ("lng", ["lng", "ガス", "gas"]), ("hydro", ["hydro", "水力", "ダム"]), ("wind", ["wind", "風力"]), ("solar", ["solar", "太陽光", "メガソーラー"]), ("geothermal", ["geothermal", "地熱"]), ("biomass", ["biomass", "バイオマス"]), ("oil", ["oil", "石油", "重油"])]
# Fuel types, and labels that stand for them.
FUEL_TYPES = ["coal", "lng", "oil", "nuclear", "hydro", "pumped_hydro", "geothermal", "wind", "solar", "biomass", "mixed", "unknown"]
FUEL_LABELS = {"石炭": "coal", "coal": "coal", "LNG": "lng", "液化天然ガス": "lng", "天然ガス": "lng", "石油": "oil", "重油": "oil", "oil": "oil", "原子力": "nuclear", "nuclear": "nuclear", "水力": "hydro", "hydro": "hydro", "揚水": "pumped_hydro", "pumped_hydro": "pumped_hydro", "地熱": "geothermal", "geothermal": "geothermal", "風力": "wind", "wind": "wind", "太陽光": "solar", "solar": "solar", "バイオマス": "biomass", "biomass": "biomass", "混合": "mixed"}
# What kind of burning means which thermal fuel, and the words of a name that overrule it.
BURNING = {"石炭": "coal", "石炭専焼": "coal", "専焼": "coal", "LNG": "gas", "ガス": "gas", "天然ガス": "gas", "石油": "oil", "重油": "oil", "軽油": "oil", "混焼": "mixed", "複合": "mixed"}
THERMAL_NAMES = [("coal", ["石炭", "Coal"]), ("gas", ["LNG", "ガス"]), ("oil", ["石油", "重油"])]
# Transformer ratings (from kV on: MVA), highest first.
TRANSFORMER_MVA = [(275.0, 800.0), (154.0, 400.0), (110.0, 200.0), (0.0, 100.0)]


def number(c: Column) -> Column:
    """The double that a trimmed text spells, else null."""
    t = F.trim(c)
    return F.when(t.rlike(NUMBER), t.cast("double"))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def voltage_first(raw: Column, missing: float | None = None) -> Column:
    """kV of the first of ``;``-separated values, commas deleted; values above 1000 are volts."""
    v = number(F.split(F.replace(F.trim(raw), F.lit(","), F.lit("")), ";")[0])
    kv = F.when(v > 1000, F.round(v / 1000, 1)).when(v > 0, F.round(v, 1))
    return kv if missing is None else F.coalesce(kv, F.lit(missing))


def voltage_max(raw: Column) -> Column:
    """kV of the largest of ``;``- or ``,``-separated values; a ``dc`` before any of them is dropped; all are volts."""
    parts = F.split(F.regexp_replace(F.lower(F.trim(raw)), "^dc", ""), "[;,]")
    value = lambda p: number(F.regexp_replace(F.trim(p), "^dc", ""))
    volts = F.array_max(F.filter(F.transform(parts, value), lambda x: x.isNotNull() & (x > 0)))
    return F.when(volts >= 1000, F.round(volts / 1000, 1)).otherwise(F.round(volts / 1000, 3))


def nearest_class(kv: Column, classes: list[float] | None = None) -> Column:
    """The class at the smallest distance; the lower one on ties; null and non-positive give the lowest."""
    classes = sorted(classes or VOLTAGE_CLASSES)
    v = F.when(kv > 600, F.when(kv > 1000, kv % 1000).otherwise(F.lit(500.0))).otherwise(kv)
    near = F.array_min(F.array(*(F.struct(F.abs(v - c).alias("d"), F.lit(c).alias("c")) for c in classes)))["c"]
    return F.when(kv > 0, near).otherwise(F.lit(classes[0]))


def tolerant_class(kv: Column, tolerance: float = 0.15) -> Column:
    """The nearest bracket if within ``tolerance`` of it (the higher on ties), else kV to one decimal."""
    best = F.array_min(F.array(*(F.struct(F.abs(kv - b).alias("d"), F.lit(-b).alias("b")) for b in BRACKETS)))
    return F.when(kv.isNotNull(), F.when(best["d"] / -best["b"] < tolerance, -best["b"]).otherwise(F.round(kv, 1)))


def step_bracket(kv: Column, steps: list[float] | None = None) -> Column:
    """The highest step that kV reaches, 0 below all; null counts as 0."""
    out = F.lit(0.0)
    for s in sorted(steps or VOLTAGE_CLASSES):
        out = F.when(kv >= s, F.lit(s)).otherwise(out)
    return out


def exact_class(kv: Column) -> Column:
    """kV rounded half to even if that is a class, else 0 (regional)."""
    r = F.rint(kv)
    return F.when(r.isin([float(round(c)) for c in VOLTAGE_CLASSES]), r).otherwise(F.lit(0.0)).cast("int")


def capacity_found(raw: Column) -> Column:
    """MW of the first number anywhere in a text, in the kW (also without a unit), MW or GW after it; -1 without one."""
    pattern = "(?i)([0-9.]+)\\s*(kW|MW|GW)?"
    v, unit = number(F.regexp_extract(raw, pattern, 1)), F.upper(F.regexp_extract(raw, pattern, 2))
    return F.coalesce(F.round(F.when(unit == "GW", v * 1000).when(unit == "MW", v).otherwise(v / 1000), 3), F.lit(-1.0))


def capacity_plain(raw: Column) -> Column:
    """MW of a text after `` MW`` and commas are taken out; null unless positive."""
    v = number(F.replace(F.replace(raw, F.lit(" MW"), F.lit("")), F.lit(","), F.lit("")))
    return F.when(v > 0, v)


def capacity_mw(raw: Column) -> Column:
    """MW from text with gw, mw, kw or w; without a unit, 1000 and more are watts."""
    t = F.lower(F.replace(F.replace(F.trim(raw), F.lit(","), F.lit("")), F.lit(" "), F.lit("")))
    v = number(F.regexp_extract(t, "^([0-9.]+)(gw|mw|kw|w)?$", 1))
    unit = F.regexp_extract(t, "^([0-9.]+)(gw|mw|kw|w)?$", 2)
    plain = F.when(v >= 1000, F.round(v / 1e6, 2)).otherwise(F.round(v, 1))
    return F.when(unit == "gw", F.round(v * 1000, 1)).when(unit == "mw", F.round(v, 1)).when(unit == "kw", F.round(v / 1000, 2)).when(unit == "w", F.round(v / 1e6, 3)).otherwise(plain)


def capacity_repaired(mw: Column) -> Column:
    """Negative is missing; above a million are watts; above ten thousand are kilowatts."""
    return F.when(mw < 0, None).when(mw > 1e6, F.round(mw / 1e6, 2)).when(mw > 10000, F.round(mw / 1000, 2)).otherwise(F.round(mw, 2))


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in chain(*pairs.items())))[key]


def fuel_of_tag(raw: Column) -> Column:
    """First of ``;``-separated values through the names of tags; unknown ones pass, blank is unknown."""
    key = F.lower(F.trim(F.split(raw, ";")[0]))
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("unknown")).otherwise(F.coalesce(lookup(FUEL_TAGS, key), key))


def fuel_of_list(raw: Column, default: str | None = "unknown") -> Column:
    """A whole value (two fuels included) through the names of lists; others get ``default``, or pass if it is None."""
    key = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.coalesce(lookup(FUEL_LISTS, key), key if default is None else F.lit(default))


def fuel_of_model(raw: Column) -> Column:
    """The model's name of a fuel; names that need no change pass as they are, null is unknown."""
    c = F.coalesce(raw, F.lit("unknown"))
    return F.coalesce(lookup(FUEL_MODEL, F.lower(F.trim(c))), c)


def fuel_type(raw: Column) -> Column:
    """A fuel type by its own name in any case, then by a label; else unknown."""
    own = F.lower(F.trim(raw))
    return F.when(own.isin(FUEL_TYPES), own).otherwise(F.coalesce(lookup(FUEL_LABELS, raw), F.lit("unknown")))


def thermal_fuel(burning: Column, name: Column) -> Column:
    """The fuel of a thermal plant: gas unless its burning or name says otherwise; some names overrule all."""
    out = F.lit("gas")
    for word, kind in reversed(BURNING.items()):
        out = F.when(F.contains(burning, F.lit(word)) | F.contains(name, F.lit(word)), F.lit(kind)).otherwise(out)
    for kind, words in reversed(THERMAL_NAMES):
        for word in words:
            out = F.when(F.contains(name, F.lit(word)), F.lit(kind)).otherwise(out)
    return out


def fuel_by_keyword(name: Column) -> Column:
    """The first category one of whose keywords the lower-cased name holds, else unknown."""
    low = F.lower(name)
    out = F.lit("unknown")
    for category, words in reversed(FUEL_KEYWORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(category)).otherwise(out)
    return out


def operator_name(raw: Column, names: list[tuple[str, str]]) -> Column:
    """Exact name first, then the first listed prefix, else the text itself; blank is null."""
    out = raw
    for prefix, name in reversed(names):
        out = F.when(F.startswith(raw, F.lit(prefix)), F.lit(name)).otherwise(out)
    for full, name in reversed(names):
        out = F.when(raw == full, F.lit(name)).otherwise(out)
    return blank_to_null(out)


def is_synthetic(name: Column) -> Column:
    """Empty, null, or a generated placeholder such as plant_12."""
    return name.isNull() | (F.trim(name) == "") | name.rlike("^(plant|sub|line)_[0-9]+$")


def display_name(name: Column, other: Column, fallback: Column) -> Column:
    return F.coalesce(blank_to_null(name), blank_to_null(other), fallback)


def place_name(area: Column, town: Column, suffix: str, fallback: Column) -> Column:
    """Area and town (once if equal) with a suffix, or the fallback if both are blank."""
    a, t = blank_to_null(area), blank_to_null(town)
    both = F.when(a.isNotNull() & t.isNotNull() & (a != t), F.concat(t, a)).otherwise(F.coalesce(a, t))
    return F.coalesce(F.concat(both, F.lit(suffix)), fallback)


def dms_to_decimal(d: Column, m: Column, s: Column) -> Column:
    return F.when(d < 0, -1.0).otherwise(1.0) * (F.abs(d) + m / 60.0 + s / 3600.0)


def decimal_to_dms(x: Column) -> Column:
    """(d, m, s) with the sign on the degrees."""
    a = F.abs(x)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    return F.struct((F.signum(x) * d).cast("int").alias("d"), m.cast("int").alias("m"), F.round((a - d - m / 60.0) * 3600, 4).alias("s"))


def capacitance_nf(b_us_per_km: Column, hz: float) -> Column:
    """nF per km from microsiemens per km."""
    if hz <= 0:
        raise ValueError("frequency must be positive")
    return b_us_per_km * 1e-6 / (2 * math.pi * hz) * 1e9


def safe_float(c: Column, default: float = 0.0) -> Column:
    x = number(c.cast("string"))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(F.coalesce(x, F.lit(default)))


def _day(hour: float) -> float:
    bump = lambda at, width, size: size * math.exp(-0.5 * ((hour - at) / width) ** 2)
    return 0.73 + 0.18 * math.cos(2 * math.pi * (hour - 16) / 24) + bump(10, 3, 0.06) + bump(14, 1.5, 0.18) + bump(18, 1.2, 0.14)


def _season(day: int) -> float:
    return 0.90 + max(0.10 * math.cos(2 * math.pi * (day - peak) / 365) for peak in (30, 210))


def daily_shape(hour: Column) -> Column:
    """Demand over a day, the largest of its 24 hours being 1: a wave with shoulders at 10, 14 and 18."""
    bump = lambda at, width, size: F.lit(size) * F.exp(F.lit(-0.5) * F.pow((hour - at) / F.lit(width), 2))
    wave = F.lit(0.73) + F.lit(0.18) * F.cos(F.lit(2 * math.pi) * (hour - 16) / F.lit(24.0))
    return (wave + bump(10, 3.0, 0.06) + bump(14, 1.5, 0.18) + bump(18, 1.2, 0.14)) / F.lit(max(_day(h) for h in range(24)))


def seasonal_shape(day: Column) -> Column:
    """Demand over a year by day (from 1), the largest being 1: peaks about days 30 and 210."""
    wave = lambda peak: F.lit(0.10) * F.cos(F.lit(2 * math.pi) * (day - peak) / F.lit(365.0))
    return (F.lit(0.90) + F.greatest(wave(30), wave(210))) / F.lit(max(map(_season, range(1, 366))))


def weekend_factor(hour_of_year: Column) -> Column:
    return F.when(F.floor(hour_of_year / 24) % 7 >= 5, 0.9).otherwise(1.0)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def tan_phi(power_factor: Column) -> Column:
    return F.tan(F.acos(power_factor))


def transformer_mva(hv: Column, tiers: list[tuple[float, float]] | None = None) -> Column:
    tiers = sorted(tiers or TRANSFORMER_MVA)
    out = F.lit(tiers[0][1])
    for kv, mva in tiers[1:]:
        out = F.when(hv >= kv, F.lit(mva)).otherwise(out)
    return out


def per_unit(r_ohm: Column, x_ohm: Column, kv: Column, base_mva: float = 100.0) -> Column:
    """(r, x) in per unit with the floors x >= 0.005 and r >= x / 20."""
    z = kv * kv / base_mva
    x = F.greatest(x_ohm / z, F.lit(0.005))
    return F.struct(F.greatest(r_ohm / z, x * 0.05).alias("r"), x.alias("x"))


def problem_mb(generators: Column, periods: Column) -> Column:
    """Memory that a commitment problem takes: five columns of 80 bytes per unit and period."""
    return generators * periods * 5 * 80 / float(1 << 20)


def csv_escaped(c: Column) -> Column:
    return F.when(c.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def loading_color(percent: Column) -> Column:
    return F.when(percent >= 100, "red").when(percent >= 80, "orange").when(percent >= 50, "yellow").otherwise("green")
