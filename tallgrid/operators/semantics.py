"""Meaning of a column from its header and from aggregates of its values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions import units
from tallgrid.functions.values import strip


def key_of(header: Column) -> Column:
    return F.lower(strip(header))


def header_dimension(header: Column) -> Column:
    """T16 without values: special plot headers, then the first dimension token inside the header."""
    key = key_of(header)
    rules = [("plot_id", catalog.PLOT_TOKENS), *catalog.DIMENSION_TOKENS.items()]
    return units.first_token(key, rules)


def header_measure(header: Column) -> Column:
    """T17."""
    key = key_of(header)
    level = r"^n_\d+"  # fixed value: nitrogen level columns are yields
    return F.coalesce(units.first_token(key, catalog.MEASURE_TOKENS.items()),
                      F.when(key.rlike(level), F.lit("yield")))


def label_aggregates(text: Column) -> dict[str, Column]:
    """T15 inputs: aggregates over the non-missing values of a column."""
    value = F.lower(strip(text))
    numbered = r"^\d+\.\s+\S+"  # fixed value: numbered labels such as "1. Mv"
    return {
        "all_roman": F.bool_and(value.isin(*catalog.ROMAN_REPLICATES)),
        "any_treatment": F.bool_or(units.contains_any(value, catalog.TREATMENT_HINTS)),
        "any_variety": F.bool_or(units.contains_any(F.concat(F.lit(" "), value, F.lit(" ")),
                                                    catalog.VARIETY_HINTS)),
        "n_numbered": F.count_if(value.rlike(numbered)),
    }


def value_dimension(n: Column, all_roman: Column, any_treatment: Column, any_variety: Column,
                    n_numbered: Column) -> Column:
    """T15."""
    return (F.when((n > 0) & all_roman, "replicate")
            .when((n >= 2) & any_treatment, "treatment")
            .when((n > 0) & (any_variety | (n_numbered / n >= 0.5)), "variety"))


def semantic_role(header: Column, suggested: Column, annotation_like: Column) -> Column:
    """T18."""
    key, dimension = key_of(header), header_dimension(header)
    generic = header.startswith(catalog.GENERIC_PREFIX)
    return (F.when((suggested == "date") | units.contains_any(key, catalog.DATE_TOKENS), "date")
            .when(key.isin(*catalog.IGNORED_HEADERS), "ignore")
            .when((generic | annotation_like) & dimension.isNull(), "ignore")
            .when(dimension.isNotNull(), "dimension")
            .when((suggested == "numeric") | header_measure(header).isNotNull(), "measure")
            .otherwise("ignore"))
