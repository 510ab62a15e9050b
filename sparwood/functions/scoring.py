"""Scores as null-strict Column expressions: unknown stays null, never 0, unless a docstring says otherwise.

NaN counts as null; ``known`` turns it into null at the border of every table.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import priors as P


def known(c: Column) -> Column:
    """NaN as null, the one missing value."""
    return F.when(~F.isnan(c), c)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Into [lo, hi]; null stays null, unlike with greatest and least alone."""
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)


def lookup(code: Column, values: dict) -> Column:
    """CASE over a small fixed table; codes without value give null."""
    first, *rest = [(k, v) for k, v in values.items() if v is not None] or [(None, None)]
    return reduce(lambda c, kv: c.when(code == kv[0], F.lit(kv[1])), rest, F.when(code == first[0], F.lit(first[1])))


def species_key(c: Column) -> Column:
    """Spelling of a species made comparable: trimmed, lower case, hyphens and blanks as underscores; blank text is null."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[-\s]", "_"), F.lit(""))


def boolean(c: Column) -> Column:
    """True and False also from their spellings after a text round trip; anything else is null."""
    return lookup(c.cast("string"), {"true": True, "True": True, "false": False, "False": False})


# Composition


def diversity(fractions: list[Column]) -> Column:
    """Shannon index over the categories that are present; 0 (not -0) for one category."""
    return reduce(lambda a, f: a + F.when(f > 0, -f * F.ln(f)).otherwise(0.0), fractions, F.lit(0.0)) + 0.0


def composition_contrast(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.abs(p - q) for p, q in zip(a, b)]) / 2


def dominant(fractions: list[Column]) -> tuple[Column, Column]:
    """Category of largest share, the first of equals, and its share."""
    top = F.greatest(*fractions)
    first, *rest = zip(fractions, P.CATEGORIES)
    return reduce(lambda c, fn: c.when(fn[0] == top, fn[1]), rest, F.when(first[0] == top, first[1])), top


# Habitat


def host_score(species: str, fraction: dict[str, Column]) -> Column:
    """Best host, not the sum; null if the stand's composition is unknown."""
    one = [F.lit(a) * F.least(F.lit(1.0), fraction[t] / sat) for t, (a, sat) in P.HOSTS[species].items()]
    best = F.greatest(*one) if len(one) > 1 else one[0]
    return F.when(reduce(lambda x, y: x & y, [fraction[t].isNotNull() for t in P.HOSTS[species]]), best)


def site_group(code: Column) -> Column:
    return lookup(code, {c: g for g, (codes, _) in P.SITES.items() for c in codes})


def site_moisture(code: Column) -> Column:
    return lookup(code, {c: m for codes, _ in P.SITES.values() for c, m in codes.items()}).cast("int")


def site_score(species: str, code: Column) -> Column:
    """Null for codes without group and groups without score."""
    i = P.SPECIES.index(species)
    return lookup(code, {c: s[i] for codes, s in P.SITES.values() for c in codes})


def site_modifier(score: Column) -> Column:
    return 0.5 + 0.5 * score


# Ecotone


def site_changed(a: Column, b: Column) -> Column:
    """Plain difference of the codes, unmapped ones too."""
    return a != b


def group_changed(a: Column, b: Column) -> Column:
    return site_group(a) != site_group(b)


def moisture_contrast(a: Column, b: Column) -> Column:
    return F.abs(site_moisture(a) - site_moisture(b)) / 4


def age_contrast(a: Column, b: Column) -> Column:
    return F.abs(lookup(a, P.AGE_RANKS) - lookup(b, P.AGE_RANKS)) / 6


def site_dimension(moisture: Column, changed: Column) -> Column:
    return F.coalesce(moisture, changed.cast("double"))


def exploration(evidence: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Bonus, signal and coverage: missing evidence drops out of signal and coverage alike, and isn't made up for."""
    signal = reduce(lambda a, b: a + b, [F.coalesce(evidence[k] * w, F.lit(0.0)) for k, w in P.EVIDENCE.items()])
    coverage = reduce(lambda a, b: a + b, [F.when(evidence[k].isNotNull(), w).otherwise(0.0) for k, w in P.EVIDENCE.items()])
    return P.BONUS * signal, signal, coverage


def ecotone_score(a: Column, b: Column, bonus: Column) -> Column:
    high, low = F.when(a >= b, a).otherwise(b), F.when(a >= b, b).otherwise(a)
    return F.when(a.isNotNull() & b.isNotNull(), (P.BEST * high + P.WORST * low) * (1 + bonus))


# Access


def access_score(distance: Column) -> Column:
    """0 beyond the cap, and for no road at all."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance / P.ACCESS_CAP_M), F.lit(0.0))


def access_reason(distance: Column, kind: Column) -> Column:
    """Metres rounded half to even; the other text only where there is no road at all."""
    text = F.concat(F.bround(distance, 0).cast("bigint").cast("string"), F.lit("m from "), F.coalesce(kind, F.lit("unknown")), F.lit("-class road"))
    return F.when(distance.isNotNull(), text).otherwise(f"no car-accessible road within {P.ACCESS_CAP_M:.0f}m")


def car_class(kind: Column, surface: Column) -> Column:
    """Class of a road; unknown types and surfaces are an error, as a silent null would hide roads."""
    unknown = F.raise_error(F.concat_ws(" ", F.lit("road of unknown type or surface:"), kind, surface)).cast("string")
    return F.coalesce(known_car_class(kind, surface), unknown)


def known_car_class(kind: Column, surface: Column) -> Column:
    """Class of a road, null for unknown types and surfaces."""
    c = reduce(lambda c, kv: c.when(kind.isin(*kv[1]), kv[0]), list(P.ROAD_CLASSES.items())[1:], F.when(kind.isin(*P.ROAD_CLASSES["HIGH_CONFIDENCE"]), "HIGH_CONFIDENCE"))
    for name, surfaces in P.OTHER_ROAD_SURFACES.items():
        c = c.when((kind == P.OTHER_ROAD) & surface.isin(*surfaces), name)
    return c


# Fruiting


def rain_response(mm: Column, scale: float) -> Column:
    return 1 - F.exp(-mm / scale)


def moisture_trigger(species: str, bins: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [w * rain_response(mm, s) for w, mm, s in zip(P.RAIN_WEIGHTS[species], bins, P.RAIN_SCALES)])


def temperature_curve(t: Column) -> Column:
    """0.4 outside 2 to 26 degrees, rising to 8, level to 18, falling to 26."""
    return (
        F.when(t.isNull(), F.lit(None).cast("double")).when((t <= 2) | (t >= 26), 0.4)
        .when(t < 8, 0.4 + 0.6 * (t - 2) / 6).when(t <= 18, 1.0).otherwise(1.0 - 0.6 * (t - 18) / 8)
    )


def frost_guard(night: Column) -> Column:
    return F.when(night.isNull(), F.lit(None).cast("double")).when(night >= 2, 1.0).when(night <= -2, 0.6).otherwise(0.6 + 0.4 * (night + 2) / 4)


def temperature_modifier(mean: Column, night: Column) -> Column:
    return temperature_curve(mean) * frost_guard(night)


def persistence_modifier(night_humidity: Column, wet_hours: Column, hours_since_rain: Column) -> Column:
    """Missing recency counts as 0, missing humidity or wet hours make the result null."""
    recency = F.coalesce(F.pow(F.lit(2.0), -hours_since_rain / 72), F.lit(0.0))
    return 0.6 + 0.4 * (0.5 * clamp((night_humidity - 65) / 25) + 0.2 * (1 - F.exp(-wet_hours / 6)) + 0.3 * recency)


def season_prior(species: str, month_day: str) -> float:
    """Piecewise linear in the days of a leap year."""
    at = lambda md: date(2000, int(md[:2]), int(md[3:])).toordinal()
    knots = [(at(k), v) for k, v in sorted(P.SEASONS[species].items())]
    day = at(month_day)
    if day <= knots[0][0]:
        return knots[0][1]
    for (d0, v0), (d1, v1) in zip(knots, knots[1:]):
        if day <= d1:
            return v0 + (v1 - v0) * (day - d0) / (d1 - d0)
    return knots[-1][1]


def worst_quality(a: Column, b: Column) -> Column:
    """The same if equal; "complete" gives way to the other; else the smaller text. Null if either is."""
    return F.when(a == b, a).when(a == "complete", b).when(b == "complete", a).when(a < b, a).when(b < a, b)


# Weather quality


def data_quality(coverage: dict[int, Column], met_age_hours: Column, met_coverage: Column) -> Column:
    """Flags in order, joined by ";"; stale met data hide their gaps; "complete" if there are none."""
    flags = [F.when(F.coalesce(c, F.lit(0.0)) < P.MIN_COVERAGE, f"partial_radar_gap_{d}d") for d, c in coverage.items()]
    met = F.when(met_age_hours.isNull() | (met_age_hours > P.STALE_HOURS), "stale_meps").when(met_coverage < P.MIN_COVERAGE, "partial_meps_gap")
    text = F.concat_ws(";", *flags, met)
    return F.when(text == "", "complete").otherwise(text)


def coverage(value: Column) -> Column:
    """Part of what was expected: null is 0; outside 0 to 1 is an error, as it would be one of counting."""
    c = F.coalesce(value, F.lit(0.0))
    return F.when((c >= 0) & (c <= 1), c).otherwise(F.raise_error(F.concat(F.lit("coverage outside 0 to 1: "), c.cast("string"))).cast("double"))


def if_covered(value: Column, coverage: Column) -> Column:
    return F.when(coverage >= P.MIN_COVERAGE, value)


def rain_bin(wide: Column, narrow: Column) -> Column:
    """Rain of the longer window without that of the shorter; a difference below -1e-6 is an error, above it is 0 at least."""
    d = wide - narrow
    return F.when(d < -1e-6, F.raise_error(F.lit("rain of a longer window is less than that of a shorter")).cast("double")).when(d < 0, 0.0).otherwise(d)
