"""Unit expressions generated from the unit catalogue (no join, no broadcast: the tables are fixed literals)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions.values import strip


def lookup(c: Column, table: dict) -> Column:
    """A fixed mapping as one literal map; NULL for unknown keys."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), c)


def first_token(text: Column, rules) -> Column:
    """The result of the first (result, tokens) rule with a token inside ``text``."""
    out = None
    for result, tokens in rules:
        hit = contains_any(text, tokens)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out


def contains_any(text: Column, tokens) -> Column:
    hit = F.lit(False)
    for token in tokens:
        hit = hit | text.contains(token)
    return hit


def normalize_unit(unit: Column) -> Column:
    """F13."""
    return lookup(F.lower(strip(unit)), catalog.UNIT_ALIASES)


def canonical_unit(measure: Column) -> Column:
    """F14."""
    return lookup(measure, catalog.CANONICAL_UNIT)


def supported_units(measure: Column) -> Column:
    """the units a measure accepts, in catalogue order."""
    table = {m: [u for mm, u, _ in catalog.UNIT_FACTORS if mm == m] for m in catalog.MEASURES}
    out = None
    for m, units in table.items():
        value = F.array(*[F.lit(u) for u in units])
        out = F.when(measure == m, value) if out is None else out.when(measure == m, value)
    return out


def is_supported(measure: Column, unit: Column) -> Column:
    """F14."""
    pair = F.concat_ws("|", measure, normalize_unit(unit))
    known = pair.isin(*[f"{m}|{u}" for m, u, _ in catalog.UNIT_FACTORS])
    return F.coalesce(known & unit.isNotNull() & measure.isNotNull(), F.lit(False))


def infer_unit(column: Column, measure: Column) -> Column:
    """first unit token inside the header, else the only unit the measure has."""
    key = F.lower(strip(column))
    out = None
    for m, rules in catalog.UNIT_TOKENS.items():
        units = [u for mm, u, _ in catalog.UNIT_FACTORS if mm == m]
        value = first_token(key, rules)
        if len(units) == 1:
            value = F.coalesce(value, F.lit(units[0]))
        out = F.when(measure == m, value) if out is None else out.when(measure == m, value)
    return out


def unit_factor(measure: Column, unit: Column) -> Column:
    factors = {f"{m}|{u}": f for m, u, f in catalog.UNIT_FACTORS if f is not None}
    return F.when(measure.isNotNull() & unit.isNotNull(), lookup(F.concat_ws("|", measure, unit), factors))


def normalize_value(measure: Column, value: Column, unit: Column) -> Column:
    """F16: value in the canonical unit rounded to 6, NULL where no conversion exists."""
    return F.round(value * unit_factor(measure, unit), 6)
