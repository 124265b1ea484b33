"""Substring matching between two tables as an equi-join.

A pattern inside a text must start somewhere in it, so the pattern's first characters are one of the text's
character windows. Joining windows with pattern heads finds every candidate without comparing all pairs; a
``contains`` test on the candidates makes the result exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrid.functions.text import substring_positions
from tallgrid.session import cut, lookup
from tallgrid.sources.cells import unsent

HEAD = 5


def contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """All (text row, pattern row) pairs where the pattern occurs in the text; column names must be disjoint.

    A text opens into a row per window, which the planner takes for as small as the text, so these rows are never sent whole to
    the driver; patterns are sent where they are few.
    """
    windows = F.array_distinct(F.concat(*[substring_positions(F.col(text), n) for n in range(1, HEAD + 1)]))
    heads = patterns.filter(F.length(pattern) > 0).withColumn("_head", F.substring(F.col(pattern), 1, HEAD))
    opened = texts.withColumn("_head", F.explode(windows))
    return unsent(opened).join(lookup(heads), "_head").filter(F.col(text).contains(F.col(pattern))).drop("_head")


def contained_in_place(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """``contained`` for patterns that every task can hold: texts are opened where they are and neither moved nor sorted."""
    sizes = F.least(F.length(pattern), F.lit(HEAD))
    heads = cut(patterns.filter(F.length(pattern) > 0).withColumn("_head", F.substring(F.col(pattern), 1, HEAD)))
    used = sorted(r[0] for r in heads.select(sizes.alias("n")).distinct().collect())  # HEAD at most
    if not used:
        return texts.join(heads.drop("_head"), F.lit(False))
    windows = F.array_distinct(F.concat(*[substring_positions(F.col(text), n) for n in used]))
    opened = texts.withColumn("_head", F.explode(windows))
    return opened.join(F.broadcast(heads), "_head").filter(
        (F.length(pattern) <= HEAD) | F.col(text).contains(F.col(pattern))).drop("_head")
