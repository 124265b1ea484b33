"""Read queries on harmonised observations (list, aggregate, distinct, top, summaries)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions import units
from tallgrid.operators import quality

EQUALITY_FILTERS = ("upload_session_id", "variable", "variety", "location", "treatment", "plot_id",
                    "validation_status", "normalized_unit")


def list_order() -> list[Column]:
    """Q5."""
    names = ("observation_date", "variable", "plot_id", "source_sheet", "block_id", "source_row_index",
             "source_column")
    return [F.col(n).asc_nulls_last() for n in names]


def filter_observations(obs: DataFrame, filters: dict | None = None) -> DataFrame:
    """Q2-Q4: AND of the filters that are present; NULL and empty ones are ignored."""
    for name, value in (filters or {}).items():
        if name not in catalog.LIST_FILTERS:
            raise ValueError(f"unknown filter {name}")
        if value is None or value == "":
            continue
        if name in EQUALITY_FILTERS:
            obs = obs.filter(F.col(name) == F.lit(value))
        elif name == "observation_date_from":
            obs = obs.filter(F.col("observation_date") >= F.lit(value).cast("date"))
        elif name == "observation_date_to":
            obs = obs.filter(F.col("observation_date") <= F.lit(value).cast("date"))
        else:
            obs = obs.filter(F.array_contains("quality_flags", value))
    return obs


def list_observations(obs: DataFrame, filters: dict | None = None,
                      limit: int = catalog.LIST_LIMIT_DEFAULT) -> DataFrame:
    """Q1."""
    catalog.check_limit(limit, catalog.LIST_LIMIT_MAX)
    return filter_observations(obs, filters).select(*catalog.LIST_COLUMNS).orderBy(*list_order()).limit(limit)


def aggregate(obs: DataFrame, group_by: str, metric: str, filters: dict | None = None,
              include_invalid: bool = False) -> DataFrame:
    """Q6-Q8: one group column; average of normalised values or count."""
    filters = filters or {}
    if group_by not in catalog.LIST_GROUPS or metric not in catalog.LIST_METRICS:
        raise ValueError("unsupported group or metric")
    averaging = metric == "avg_normalized_value"
    if averaging and group_by == "validation_status":
        raise ValueError("averages are not grouped by validation_status")
    if averaging and not filters.get("variable"):
        raise ValueError("averages need a variable")
    rows = filter_observations(obs, filters)
    if averaging:
        rows = rows.filter(F.col("normalized_value").isNotNull())
    if not filters.get("validation_status") and not include_invalid and group_by != "validation_status":
        rows = rows.filter(F.col("validation_status") != "invalid")
    groups = _averages(rows, F.col(group_by)) if averaging else _counts(rows, F.col(group_by))
    return groups.orderBy(F.col("group_value").asc_nulls_last())


def _averages(rows: DataFrame, group: Column | None) -> DataFrame:
    """Average, count and unit of rows with a normalised value.

    Sums per (group, unit) need numeric buffers only, so all rows go through a hash aggregate; the maximum of the
    unit texts, which would sort its input, sees one row per group and unit.
    """
    keys = [] if group is None else [group.alias("group_value")]
    sums = rows.groupBy(*keys, "normalized_unit").agg(
        F.sum("normalized_value").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(*[F.col("group_value") for _ in keys]).agg(
        (F.sum("s") / F.sum("n")).alias("metric_value"), F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"),
        F.max("normalized_unit").alias("normalized_unit"))


def _counts(rows: DataFrame, group: Column | None) -> DataFrame:
    n = F.count(F.lit(1))
    keys = [] if group is None else [group.alias("group_value")]
    return rows.groupBy(*keys).agg(n.cast("double").alias("metric_value"), n.alias("record_count")).withColumn(
        "normalized_unit", F.lit(None).cast("string"))


def count_by_status(rows: DataFrame) -> DataFrame:
    """Q7 on normalised observations that are not judged yet: statuses are counted by duplicate key, no row is flagged for it."""
    n = F.sum("n")
    return (quality.status_sums(rows, [], values=False).groupBy(F.col("validation_status").alias("group_value"))
            .agg(n.cast("double").alias("metric_value"), n.alias("record_count"))
            .withColumn("normalized_unit", F.lit(None).cast("string")).orderBy(F.col("group_value").asc_nulls_last()))


DISTINCT_FIELDS = ("variable", "normalized_unit", "variety", "location", "treatment", "plot_id",
                   "validation_status")


def distinct_values(obs: DataFrame, fields: tuple[str, ...] = DISTINCT_FIELDS) -> DataFrame:
    """Q9: (field, value) of every catalogue field in one scan and one small shuffle."""
    return (obs.select(*[F.col(f).cast("string").alias(f) for f in fields])
            .unpivot([], list(fields), "field", "value")
            .filter(F.col("value").isNotNull()).distinct())


def distinct_flags(obs: DataFrame) -> DataFrame:
    """Q10."""
    return obs.select(F.explode("quality_flags").alias("quality_flag")).distinct()


def plan_filter(rows: DataFrame, field: str, operator: str, value) -> DataFrame:
    """Q11."""
    if field not in catalog.PLAN_FILTER_FIELDS:
        raise ValueError(f"field {field} cannot be filtered")
    c = F.col(field)
    literal = lambda v: F.lit(v).cast("date") if field == "observation_date" else F.lit(v)
    if operator == "eq":
        return rows.filter(c == literal(value))
    if operator == "gte":
        return rows.filter(c >= literal(value))
    if operator == "lte":
        return rows.filter(c <= literal(value))
    if operator == "in":
        return rows.filter(c.isin([value] if isinstance(value, str) else list(value)))
    if operator == "ilike":
        return rows.filter(c.cast("string").ilike(value if "%" in value else f"%{value}%"))
    raise ValueError(f"unknown operator {operator}")


def apply_plan_filters(rows: DataFrame, filters: list[tuple]) -> DataFrame:
    return reduce(lambda df, f: plan_filter(df, *f), filters, rows)


def judged_where(rows: DataFrame, filters: list[tuple]) -> DataFrame:
    """Q11 on normalised observations that are not judged yet: filters on fields of the duplicate key keep or drop all rows of a key,
    so they come first and only what they keep is counted and judged."""
    first = [f for f in filters if f[0] in catalog.DUPLICATE_KEY]
    return apply_plan_filters(quality.validate(apply_plan_filters(rows, first)), [f for f in filters if f not in first])


def safe_view(obs: DataFrame) -> DataFrame:
    """S10."""
    return obs.select(*catalog.SAFE_COLUMNS)


def select_records(obs: DataFrame, filters: list[tuple], order: list[tuple[str, str]] | None = None,
                   limit: int = catalog.PLAN_LIMIT_DEFAULT) -> DataFrame:
    """Q12."""
    catalog.check_limit(limit, catalog.PLAN_LIMIT_MAX)
    order = order or [("observation_date", "asc"), ("variable", "asc"), ("plot_id", "asc")]
    keys = [F.col(f).asc_nulls_last() if d == "asc" else F.col(f).desc_nulls_last() for f, d in order]
    return (apply_plan_filters(safe_view(obs), filters).orderBy(*keys)
            .limit(limit))


def aggregate_plan(obs: DataFrame, function: str, group_by: str | None, filters: list[tuple]) -> DataFrame:
    """Q13: grouped or global; averages drop NULL and invalid rows, counts keep invalid ones."""
    if group_by is not None and group_by not in catalog.PLAN_GROUPS:
        raise ValueError(f"cannot group by {group_by}")
    rows = apply_plan_filters(safe_view(obs), filters)
    if function == "avg":
        rows = rows.filter(F.col("normalized_value").isNotNull())
        if not any(f[0] == "validation_status" for f in filters):
            rows = rows.filter(F.col("validation_status") != "invalid")
    make = _averages if function == "avg" else _counts
    if group_by is None:
        return make(rows, None).select(F.lit(None).cast("string").alias("group_value"), "*")
    return make(rows, F.col(group_by))


def top_groups(groups: DataFrame, n: int = 1, lowest: bool = False) -> DataFrame:
    """Q14: ties are broken by the group name."""
    metric = F.col("metric_value").asc_nulls_last() if lowest else F.col("metric_value").desc_nulls_last()
    return groups.orderBy(metric, F.col("group_value").asc_nulls_last()).limit(n)


def top_group(groups: DataFrame) -> DataFrame:
    """Q15: the single highest group; a tie goes to the largest name."""
    best = F.max_by(F.struct("group_value", "metric_value", "record_count", "normalized_unit"),
                    F.struct(F.col("metric_value"), F.coalesce("group_value", F.lit(""))))
    return groups.agg(best.alias("b")).filter(F.col("b").isNotNull()).select("b.*")


def extreme_record(obs: DataFrame, filters: list[tuple], lowest: bool = False) -> DataFrame:
    """Q16: the record with the highest (or lowest) normalised value; list order breaks ties."""
    value = F.col("normalized_value").asc_nulls_last() if lowest else F.col("normalized_value").desc_nulls_last()
    rows = apply_plan_filters(obs, filters)
    return rows.orderBy(value, *list_order(), "upload_session_id").limit(1)


def list_multi_status(obs: DataFrame, statuses: list[str], filters: dict | None = None,
                      limit: int = catalog.A_LIMIT_MANY) -> DataFrame:
    """Q17: each status limited on its own, repeats dropped, list order, limited again."""
    rows = filter_observations(obs, filters).filter(F.col("validation_status").isin(statuses))
    per_status = Window.partitionBy("validation_status").orderBy(*list_order(), "upload_session_id")
    ranked = rows.select(*catalog.LIST_COLUMNS, F.row_number().over(per_status).alias("_rank"))
    kept = ranked.filter(F.col("_rank") <= limit)
    position = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("validation_status"))
    key = ("upload_session_id", "source_sheet", "source_row_index", "source_column")
    first = Window.partitionBy(*key).orderBy(position, "_rank")
    unique = kept.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") == 1)
    return (unique.drop("_rank", "_first").orderBy(*list_order(), "upload_session_id").limit(limit))


def cap_rows(df: DataFrame, cap: int = catalog.PLAN_LIMIT_MAX) -> DataFrame:
    """Q18: at most ``cap`` rows, each carrying whether the result was cut."""
    probe = df.limit(cap + 1)
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # over cap + 1 rows at most
    return probe.withColumn("truncated", total > cap).limit(cap)


def search_rows(obs: DataFrame, text: str) -> DataFrame:
    """Q19."""
    needle = text.strip().lower()
    fields = ("plot_id", "variety", "treatment", "location", "variable", "validation_status")
    hit = reduce(lambda a, b: a | b,
                 [F.coalesce(F.lower(F.col(f)).contains(needle), F.lit(False)) for f in fields])
    return obs.filter(hit)


def quality_summary(obs: DataFrame) -> DataFrame:
    """Q20."""
    status = F.col("validation_status")
    return obs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s) for s in catalog.STATUSES],
        F.count_if(F.size("quality_flags") > 0).alias("flagged"))


def status_counts(obs: DataFrame) -> DataFrame:
    """Q21."""
    return (obs.groupBy(F.coalesce(F.nullif(F.col("validation_status"), F.lit("")), F.lit("unknown"))
                        .alias("status")).agg(F.count(F.lit(1)).alias("n")))


def flag_counts(obs: DataFrame) -> DataFrame:
    """Q21."""
    return (obs.select(F.explode("quality_flags").alias("flag")).filter(F.col("flag") != "")
            .groupBy("flag").agg(F.count(F.lit(1)).alias("n")))


def scope_query(obs: DataFrame, upload_session_id: str | None = None, variable: str | None = None,
                limit: int = catalog.SCOPE_LIMIT) -> DataFrame:
    """Q22."""
    unit = catalog.CANONICAL_UNIT.get(variable) if variable else None
    return list_observations(obs, {"upload_session_id": upload_session_id, "variable": variable,
                                   "normalized_unit": unit}, limit)


def catalogue(obs: DataFrame) -> DataFrame:
    """Q23: (section, name, detail) rows: the closed catalogue joined with what the data holds."""
    spark = obs.sparkSession
    rows = [("dimension", d, ", ".join(catalog.DIMENSION_TOKENS[d])) for d in catalog.DIMENSIONS]
    rows += [("measure", m, ", ".join(catalog.MEASURE_TOKENS[m])) for m in catalog.MEASURES]
    rows += [("canonical_unit", m, u) for m, u in catalog.CANONICAL_UNIT.items()]
    rows += [("supported_unit", m, u) for m, u, _ in catalog.UNIT_FACTORS]
    rows += [("status", s, catalog.STATUS_TEXT[s]) for s in catalog.STATUSES]
    rows += [("flag", f, catalog.FLAG_TEXT[f]) for f in catalog.FLAGS]
    rows += [("filter", f, "") for f in catalog.LIST_FILTERS]
    rows += [("group", g, "") for g in catalog.LIST_GROUPS]
    rows += [("metric", m, "") for m in catalog.LIST_METRICS]
    rows += [("limit", "default", str(catalog.PLAN_LIMIT_DEFAULT)), ("limit", "max", str(catalog.PLAN_LIMIT_MAX))]
    fixed = spark.createDataFrame(rows, "section string, name string, detail string")
    present = distinct_values(obs).select(F.lit("available").alias("section"), F.col("field").alias("name"),
                                          F.col("value").alias("detail"))
    flags = distinct_flags(obs).select(F.lit("available").alias("section"), F.lit("quality_flag").alias("name"),
                                       F.col("quality_flag").alias("detail"))
    return fixed.unionByName(present).unionByName(flags)


def convert_units(df: DataFrame, measure: str, unit: str, value: str) -> DataFrame:
    """Q24: the unit conversion on any (measure, unit, value) table."""
    source = units.normalize_unit(F.col(unit))
    return df.withColumns({
        "source_unit": source,
        "normalized_value": units.normalize_value(F.col(measure), F.col(value), source),
        "normalized_unit": F.when(units.unit_factor(F.col(measure), source).isNotNull()
                                  & F.col(value).isNotNull(), units.canonical_unit(F.col(measure))),
    })
