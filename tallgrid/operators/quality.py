"""Normalisation and quality rules on observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions import units


def normalise_observation(df: DataFrame, measure: str = "variable") -> DataFrame:
    """H5: value in the canonical unit; NULL value and unit where no conversion applies."""
    known = F.col(measure).isin(*catalog.MEASURES)
    value = F.when(known, units.normalize_value(F.col(measure), F.col("value"), F.col("unit")))
    convertible = F.col("value").isNotNull() & units.unit_factor(F.col(measure), F.col("unit")).isNotNull()
    return df.withColumns({
        "normalized_value": value,
        "normalized_unit": F.when(known & convertible, units.canonical_unit(F.col(measure))),
    })


def is_outlier(variable: Column, value: Column) -> Column:
    """H8: strictly outside the measure's range; NaN and other variables are exempt."""
    out = None
    for name, (low, high) in catalog.OUTLIER_RANGES.items():
        outside = (value < low) | (value > high)
        out = F.when(variable == name, outside) if out is None else out.when(variable == name, outside)
    return F.coalesce(out & ~F.isnan(value), F.lit(False))


def narrow_flags(requires_date: Column) -> list[Column]:
    """H7 and H8 in flag order; each is a flag name or NULL."""
    c = F.col
    no_dimension = F.lit(True)
    for name in catalog.REQUIRED_DIMENSIONS:
        no_dimension = no_dimension & (c(name).isNull() | (c(name) == ""))
    flag = lambda condition, name: F.when(condition, F.lit(name))
    return [
        flag(c("value").isNull() & c("normalized_value").isNull(), "missing_measure_value"),
        flag(c("unit").isNull() & c("normalized_unit").isNull(), "missing_unit"),
        flag(requires_date & c("observation_date").isNull(), "missing_observation_date"),
        flag(no_dimension, "missing_required_dimension"),
        flag(is_outlier(c("variable"), c("normalized_value")), "outlier_candidate"),
    ]


def _key_hashes() -> dict[str, Column]:
    # hashes pass over NULL fields, so where these are is hashed too
    marks = [F.col(name).isNull() for name in catalog.DUPLICATE_KEY]
    fields = [F.col(name) for name in catalog.DUPLICATE_KEY]
    return {"_key1": F.xxhash64(*fields, *marks), "_key2": F.xxhash64(F.lit("second"), *marks, *reversed(fields))}


def flag_duplicates(df: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """H9: ``is_duplicate`` for groups of two or more on the twelve keys, NULLs being equal; ``among`` holds the rows that are counted
    where ``df`` is a choice of them.

    Counting is a partial aggregation, so a key that holds a third of all rows is one row per task before the
    shuffle. Keys are counted and looked up as two 64-bit hashes of them, not as twelve columns; 10^9 keys hold two of
    equal hashes with a probability of about 10^-21. The join names the hashes as expressions, so that rows carry
    nothing more on their way. Only repeated keys come back; the adaptive planner broadcasts them when their measured
    size allows and otherwise splits skewed partitions of the sort-merge join. The hashes treat NULL fields as equal, stay
    a plain equi-join, and let the optimizer drop the join when a query never looks at duplicates.
    """
    hashes = _key_hashes()
    counted = (df if among is None else among).groupBy(*[h.alias(n) for n, h in hashes.items()]).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counted.filter(F.col("_n") > 1).select(*hashes, F.lit(True).alias("_dup"))
    joined = df.join(repeated, [h == F.col(n) for n, h in hashes.items()], "left")
    return joined.select(*[F.col(n) for n in df.columns], F.coalesce(F.col("_dup"), F.lit(False)).alias("is_duplicate"))


def validate(df: DataFrame, requires_date: Column | None = None) -> DataFrame:
    """Add ``quality_flags`` and ``validation_status``."""
    return judge(flag_duplicates(df), requires_date)


def judge(flagged: DataFrame, requires_date: Column | None = None) -> DataFrame:
    """H7, H8 and H10 on rows with ``is_duplicate``: row by row, so that it can follow the last shuffle of the rows."""
    requires_date = F.lit(True) if requires_date is None else requires_date
    flags = narrow_flags(requires_date)
    blocking = flags[0].isNotNull() | flags[2].isNotNull() | flags[3].isNotNull()
    soft = flags[1].isNotNull() | flags[4].isNotNull() | F.col("is_duplicate")
    return flagged.withColumns({
        "quality_flags": F.array_compact(F.array(
            *flags, F.when(F.col("is_duplicate"), F.lit("duplicate_candidate")))),
        # nested, so that "is it invalid" folds to the blocking rules and no longer needs the duplicate count
        "validation_status": F.when(blocking, "invalid").otherwise(F.when(soft, "warning").otherwise("valid")),
    }).drop("is_duplicate")


def sure_status() -> Column:
    """The status that rows have by themselves: ``invalid``, ``warning``, or NULL where a duplicate decides between ``valid`` and ``warning``."""
    flags = narrow_flags(F.lit(True))
    return F.when(flags[0].isNotNull() | flags[2].isNotNull() | flags[3].isNotNull(), "invalid").when(
        flags[1].isNotNull() | flags[4].isNotNull(), "warning")


def status_sums(df: DataFrame, fields: list[str], duplicates: bool = True, values: bool = True) -> DataFrame:
    """(``fields``, variable, validation_status, normalized_unit, n, n_value, s_value) of normalised rows that are not judged yet, in
    parts to be added up. ``fields`` follow from the duplicate key, so one row per key travels, as two hashes with its sums, and no
    row comes back; keys whose status is settled without counting are summed by their fields. Without ``duplicates`` nothing is
    counted by key, and a row that only a duplicate makes a warning is ``valid``. Without ``values`` there are ``fields``, variable,
    status and n only.
    """
    c = F.col
    flags = narrow_flags(F.lit(True))
    settled = (flags[2].isNotNull() | flags[3].isNotNull() | c("unit").isNull()) if duplicates else F.lit(True)
    kept = [f for f in fields if f != "variable"]
    own = F.coalesce(sure_status(), F.lit("valid"))
    sums = []
    for status in catalog.STATUSES:
        mine = own == status
        value = F.when(mine, c("normalized_value"))
        sums += [F.count_if(mine).alias(f"n_{status}"), *([F.count(value).alias(f"v_{status}"), F.sum(value).alias(f"s_{status}")] if values else [])]
    keys = df.groupBy(*kept, "variable", *[F.when(~settled, h).alias(n) for n, h in _key_hashes().items()]).agg(*sums)
    repeated = c("_key1").isNotNull() & (c("n_valid") + c("n_warning") + c("n_invalid") > 1)
    unit = units.canonical_unit(c("variable"))
    entries = []
    for status in catalog.STATUSES:
        name = (F.when(repeated, "warning").otherwise("valid") if status == "valid" else F.lit(status)).alias("validation_status")
        n, v, s = (c(f"{x}_{status}") for x in "nvs")
        if not values:
            entries.append(F.struct(name, n.alias("n")))
            continue
        entries += [F.struct(name, unit.alias("normalized_unit"), v.alias("n"), v.alias("n_value"), s.alias("s_value")),
                    F.struct(name, F.lit(None).cast("string").alias("normalized_unit"), (n - v).alias("n"),
                             F.lit(0).cast("long").alias("n_value"), F.lit(None).cast("double").alias("s_value"))]
    return keys.select(*kept, "variable", F.inline(F.array(*entries))).filter(c("n") > 0)


def status_of_flags(flags: Column) -> Column:
    """H10 from an existing flag array."""
    blocking = F.array(*[F.lit(f) for f in catalog.BLOCKING_FLAGS])
    return F.when(F.arrays_overlap(flags, blocking), "invalid").when(F.size(flags) > 0, "warning").otherwise("valid")
