"""Plans of many questions, and their joint execution on the observations.

A plan row holds: question_id, supported, intent (select, aggregate, top_group), group_by, function (avg, count),
direction (asc, desc, NULL), top (rows to keep of an ordered aggregate), row_limit (NULL: no limit), exclude_invalid, dedupe, the
equality filters f_* and the status list. Every filter is an equality. The combinations of used filters that occur (a handful;
at most 2^10 exist) are numbered; one scan gives each observation a key per combination, and plans meet them in one equi-join
on (combination, key), also plans without a filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions import units
from tallgrid.operators import quality, queries
from tallgrid.session import LOOKUP_ROWS, cut

FILTERS = {"f_upload_session_id": "upload_session_id", "f_variable": "variable", "f_variety": "variety",
           "f_location": "location", "f_treatment": "treatment", "f_plot_id": "plot_id",
           "f_normalized_unit": "normalized_unit", "f_day": "observation_date", "f_year": "observation_year",
           "f_status": "validation_status"}
PLAN_COLUMNS = ("question_id", "status", "intent", "result_type", "note", "group_by", "function", "direction", "top",
                "row_limit", "exclude_invalid", "dedupe", "statuses",
                *[f for f in FILTERS if f != "f_status"])


def plan_a(tags: DataFrame, upload_session_id: str | None = None, variable: str | None = None) -> DataFrame:
    """Top group, aggregate, record list or unsupported; explicit scope replaces what was detected."""
    c = F.col
    dimension_group = F.coalesce(c("group_by").isin("variety", "treatment", "location"), F.lit(False))
    top = c("has_top") & c("has_average") & F.coalesce(c("measure") == "yield", F.lit(False)) & dimension_group
    average = c("has_average") & c("measure").isNotNull() & dimension_group
    found = F.coalesce("f_location", "f_variety", "f_treatment", "f_plot_id", "measure")
    records = (F.size("statuses") > 0) | c("has_list") | found.isNotNull()
    intent = (F.when(c("q") == "", F.lit(None)).when(top, "top_group").when(average, "aggregate")
              .when(records, "select"))
    listed = intent == "select"
    scoped = F.lit(variable) if variable else c("measure")
    return tags.select(
        "question_id", F.when(intent.isNull(), "unsupported").otherwise("supported").alias("status"),
        F.coalesce(intent, F.lit("unsupported")).alias("intent"),
        F.coalesce(F.when(listed, "records").when(intent == "aggregate", "aggregation").otherwise(intent),
                   F.lit("unsupported")).alias("result_type"),
        F.lit(None).cast("string").alias("note"),
        F.when(~listed, c("group_by")).alias("group_by"), F.when(~listed, "avg").alias("function"),
        F.lit(None).cast("string").alias("direction"), F.when(intent == "top_group", 1).alias("top"),
        F.when(listed, F.when(F.size("statuses") > 1, catalog.A_LIMIT_MANY).otherwise(catalog.A_LIMIT)).alias("row_limit"),
        F.coalesce(~listed, F.lit(False)).alias("exclude_invalid"),
        F.coalesce(listed & (F.size("statuses") > 1), F.lit(False)).alias("dedupe"),
        F.when(listed, c("statuses")).otherwise(F.array().cast("array<string>")).alias("statuses"),
        F.lit(upload_session_id).cast("string").alias("f_upload_session_id"), scoped.alias("f_variable"),
        "f_variety", "f_location", "f_treatment", "f_plot_id", units.canonical_unit(scoped).alias("f_normalized_unit"),
        F.lit(None).cast("date").alias("f_day"), F.lit(None).cast("int").alias("f_year"))


def plan_b(tags: DataFrame) -> DataFrame:
    """N11 with N8 and N9: screens, clarifications, aggregate branch, record branch, unsupported."""
    c = F.col
    measure = F.when(F.size("measures") == 1, c("measures")[0])
    function = F.when(c("has_average"), "avg").when(c("has_count"), "count")
    ranked = c("has_top") | c("has_low")
    aggregating = function.isNotNull() | c("has_top")
    chosen = F.coalesce(function, F.when(ranked, F.when(measure.isNotNull(), "avg").otherwise("count")))
    values = F.coalesce("f_variety", "f_location", "f_treatment", "f_plot_id")
    dated = c("f_day").isNotNull() | c("f_year").isNotNull()
    narrowed = values.isNotNull() | dated | (F.size("statuses") > 0)
    listing = c("has_list") | c("group_by").isNotNull() | narrowed
    broad = c("wants_all") | (measure.isNull() & ~narrowed)
    note = (F.when(c("q") == "", "empty")
            .when(c("is_unsafe"), "unsafe_request")
            .when(F.size("measures") > 1, "multiple_measures")
            .when(aggregating & (chosen == "avg") & measure.isNull(), "missing_measure")
            .when(aggregating & ranked & c("group_by").isNull(), "missing_grouping")
            .when(~aggregating & ~listing, "no_intent")
            .when(~aggregating & broad, "too_broad_request"))
    status = (F.when(note.isin("multiple_measures", "missing_measure", "missing_grouping"), "clarification_required")
              .when(note.isNotNull(), "unsupported").otherwise("supported"))
    intent = F.when(note.isNotNull(), status).when(aggregating, "aggregate").otherwise("select")
    aggregate = intent == "aggregate"
    limit = F.coalesce("limit_override", "asked_limit", F.lit(catalog.PLAN_LIMIT_DEFAULT))
    capped = F.least(limit, F.lit(catalog.PLAN_LIMIT_MAX))
    top = F.least(capped, F.coalesce(F.nullif(c("asked_limit"), F.lit(0)), F.lit(1)))
    return tags.select(
        "question_id", status.alias("status"), intent.alias("intent"),
        F.when(intent == "select", "records").when(aggregate, "aggregation").otherwise("unsupported")
        .alias("result_type"), note.alias("note"), F.when(aggregate, c("group_by")).alias("group_by"),
        F.when(aggregate, chosen).alias("function"),
        F.when(aggregate & ranked, F.when(c("has_low"), "asc").otherwise("desc")).alias("direction"),
        F.when(aggregate & ranked, top).alias("top"), capped.alias("row_limit"),
        (aggregate & (chosen == "avg") & (F.size("statuses") == 0)).alias("exclude_invalid"),
        F.lit(False).alias("dedupe"), "statuses", c("upload_session_id").alias("f_upload_session_id"),
        measure.alias("f_variable"), "f_variety", "f_location", "f_treatment", "f_plot_id",
        units.canonical_unit(measure).alias("f_normalized_unit"), "f_day", "f_year")


def _per_status(plans: DataFrame) -> DataFrame:
    """One row per asked status (none: a single row), so that the status is an equality like the other filters."""
    return plans.withColumn("f_status", F.explode(F.when(F.size("statuses") > 0, F.col("statuses")).otherwise(
        F.array(F.lit(None).cast("string"))))).withColumn(
        "signature", F.concat_ws(",", *[F.when(F.col(f).isNotNull(), F.lit(f)) for f in FILTERS]))


def _combinations(plans: DataFrame, *extra: str) -> list[tuple]:
    """The filter combinations that occur: bounded by the number of filter fields, not by the data."""
    return sorted(tuple(r) for r in plans.select("signature", *extra).distinct().collect())


def _dated(obs: DataFrame) -> DataFrame:
    return obs.withColumn("observation_year", F.year("observation_date"))


def _key(fields: list[str]) -> Column:
    """The values of these fields as one text; NULL if any is missing, since no equality holds then."""
    if not fields:
        return F.lit("")
    there = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
    return F.when(there, F.concat_ws("\u001f", *[F.col(f).cast("string") for f in fields]))


def _plan_keys(plans: DataFrame, combinations: list[tuple], *extra: str) -> DataFrame:
    """Plans with the number of their combination and their key in it."""
    number, key = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (signature, *rest) in enumerate(combinations):
        own = F.col("signature") == signature
        for name, value in zip(extra, rest):
            own = own & (F.col(name) == value)
        number = F.when(own, i).otherwise(number)
        key = F.when(own, _key([f for f in signature.split(",") if f])).otherwise(key)
    return plans.withColumns({"combination": number, "key": key})


def _row_keys(rows: DataFrame, combinations: list[tuple], group=None, only=None) -> DataFrame:
    """One row per observation and combination (of the numbers in ``only``), with its key (and group value) there; a single scan of the rows."""
    entries = []
    for i, (signature, *rest) in enumerate(combinations):
        if only is not None and i not in only:
            continue
        fields = [F.lit(i).alias("combination"), _key([FILTERS[f] for f in signature.split(",") if f]).alias("key")]
        if group:
            fields.append(group(rest[0]).alias("group_value"))
        entries.append(F.struct(*fields))
    return rows.withColumn("_entry", F.explode(F.array(*entries))).select("*", "_entry.*").drop("_entry").filter(
        F.col("key").isNotNull())


def execute_aggregates(plans: DataFrame, obs: DataFrame, judged: bool = True) -> DataFrame:
    """(question_id, rank, group_value, metric_value, record_count, normalized_unit) of aggregate plans. Not ``judged``
    observations are normalised but have no status yet; duplicates are then counted only where a plan tells valid from warning.

    Observations are reduced to sums per used filter values and group before they meet the plans, so the join input
    is as small as the catalogue of values, however many plans there are. Only sums are copied to the filter combinations.
    """
    asked = cut(_per_status(
        plans.filter((F.col("status") == "supported") & F.col("intent").isin("aggregate", "top_group"))
        .withColumn("grouping", F.coalesce("group_by", F.lit("")))))
    combinations = _combinations(asked, "grouping")
    if not combinations:
        return _empty_aggregates(plans)
    # observations are read and shuffled once, to sums at the finest level in use; every combination is a roll-up of these
    used = sorted({FILTERS[f] for signature, _ in combinations for f in signature.split(",") if f}
                  | {name for _, name in combinations if name} | {"validation_status"})
    # the unit is a key here, not a maximum, so that the large aggregation hashes numbers only
    unit = F.when(F.col("n_value") > 0, F.col("normalized_unit")).alias("unit")
    if judged:
        parts = _dated(obs).withColumns({"n": F.lit(1), "n_value": F.col("normalized_value").isNotNull().cast("int"),
                                         "s_value": F.col("normalized_value")})
    else:
        telling = (F.col("grouping") == "validation_status") | F.col("f_status").isin("valid", "warning")
        parts = quality.status_sums(_dated(obs), [f for f in used if f not in ("validation_status", "normalized_unit")],
                                    not asked.filter(telling).isEmpty())
    finest = parts.groupBy(*used, unit).agg(*[F.sum(name).alias(name) for name in ("n", "n_value", "s_value")])
    keyed = _row_keys(finest, combinations,
                      lambda name: F.col(name).cast("string") if name else F.lit(None).cast("string"))
    reduced = keyed.groupBy("combination", "key", "group_value", "validation_status", "unit").agg(
        *[F.sum(name).alias(name) for name in ("n", "n_value", "s_value")])
    mine = _plan_keys(asked, combinations, "grouping").drop("validation_status")
    joined = mine.join(reduced, ["combination", "key"]).filter(
        ~F.col("exclude_invalid") | (F.col("validation_status") != "invalid"))
    averaging = F.col("function") == "avg"
    plan = ["question_id", "function", "intent", "direction", "top", "row_limit"]
    summed = joined.groupBy(*plan, "group_value").agg(
        F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.sum("s_value").alias("s_value"),
        F.max("unit").alias("unit"))
    measured = summed.filter(~averaging | (F.col("n_value") > 0)).select(
        *plan, "group_value",
        F.when(averaging, F.col("s_value") / F.col("n_value")).otherwise(F.col("n").cast("double")).alias("metric_value"),
        F.when(averaging, F.col("n_value")).otherwise(F.col("n")).alias("record_count"),
        F.when(averaging, F.col("unit")).alias("normalized_unit"))
    # the single best group of rule set A breaks ties by the larger name, an ordered listing by the smaller one
    name = F.col("group_value")
    order = [F.when(F.col("direction") == "asc", F.col("metric_value")).asc_nulls_last(),
             F.when((F.col("direction") == "desc") | (F.col("intent") == "top_group"), F.col("metric_value"))
             .desc_nulls_last(),
             F.when(F.col("intent") == "top_group", F.coalesce(name, F.lit(""))).desc_nulls_last(),
             name.asc_nulls_last()]
    ranked = measured.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    shown = ranked.filter(F.col("rank") <= F.coalesce("top", "row_limit", F.lit(2**31 - 1))).select(
        "question_id", "rank", "group_value", "metric_value", "record_count", "normalized_unit")
    # an aggregate without grouping has one row, also over nothing
    nothing = (asked.filter("grouping = ''").select("question_id", "function").distinct()
               .join(shown.select("question_id"), "question_id", "left_anti"))
    return shown.unionByName(nothing.select(
        "question_id", F.lit(1).alias("rank"), F.lit(None).cast("string").alias("group_value"),
        F.when(F.col("function") == "count", 0.0).alias("metric_value"), F.lit(0).cast("long").alias("record_count"),
        F.lit(None).cast("string").alias("normalized_unit")))


def _empty_aggregates(plans: DataFrame) -> DataFrame:
    return plans.limit(0).select("question_id", F.lit(1).alias("rank"), F.lit("").alias("group_value"),
                                 F.lit(0.0).alias("metric_value"), F.lit(0).cast("long").alias("record_count"),
                                 F.lit("").alias("normalized_unit"))


LISTED = tuple(catalog.LIST_COLUMNS)
UNDATED = 2**31 - 1


def _month(rows: DataFrame) -> DataFrame:
    """Adds the month of an observation, counted from year 0; rows without a date come last."""
    day = F.col("observation_date")
    return rows.withColumn("_month", F.coalesce(F.year(day) * 12 + F.month(day), F.lit(UNDATED)))


def _leading_months(asked_keys: DataFrame, obs: DataFrame, combinations: list[tuple]) -> DataFrame:
    """(combination, key, bar) of the asked keys: the month up to which a key has ``PLAN_LIMIT_MAX`` rows, if it has as many.

    Lists are ordered by date first, so no row of a later month leads its key. Counting hashes keys and months and sorts no rows.
    """
    fields = sorted({FILTERS[f] for signature, in combinations for f in signature.split(",") if f})
    counted = (_row_keys(_month(_dated(obs)).select(*fields, "_month"), combinations)
               .groupBy("combination", "key", "_month").agg(F.count(F.lit(1)).alias("n")))
    far = F.sum("n").over(Window.partitionBy("combination", "key").orderBy("_month"))
    bars = counted.withColumn("_far", far).filter(F.col("_far") >= catalog.PLAN_LIMIT_MAX).groupBy("combination", "key").agg(
        F.min("_month").alias("bar"))
    return asked_keys.join(bars, ["combination", "key"], "left").select("combination", "key", F.coalesce("bar", F.lit(UNDATED)).alias("bar"))


def _judged_rows(obs: DataFrame, combinations: list[tuple], asked_rows, lead) -> DataFrame:
    """Rows for the lists from observations that are not judged yet, with flags and status.

    The leading rows of a key without a status are the same whatever their status is, so they are ranked first and only they
    are judged. Where a status is part of the key, the rows that may have it are judged.
    """
    plain = [i for i, (signature,) in enumerate(combinations) if "f_status" not in signature.split(",")]
    by_status = [i for i in range(len(combinations)) if i not in plain]
    fields = ["combination", "key", "_maybe", *obs.columns]
    sets = []
    if plain:
        sets.append(lead(asked_rows(obs, plain)).withColumn("_maybe", F.lit(None).cast("string")).select(*fields))
    if by_status:
        sure = quality.sure_status()
        maybe = F.explode(F.when(sure.isNull(), F.array(F.lit("valid"), F.lit("warning"))).otherwise(F.array(sure)))
        sets.append(asked_rows(obs.withColumn("validation_status", maybe), by_status)
                    .withColumn("_maybe", F.col("validation_status")).select(*fields))
    flagged = quality.judge(quality.flag_duplicates(reduce(DataFrame.unionByName, sets), among=obs))
    return flagged.filter(F.col("_maybe").isNull() | (F.col("_maybe") == F.col("validation_status")))


def execute_lists(plans: DataFrame, obs: DataFrame, judged: bool = True) -> DataFrame:
    """(question_id, rank, observation columns) of record plans.

    No plan asks for more than ``PLAN_LIMIT_MAX`` rows, so only that many leading rows of every key meet the plans (ranked
    per task before the shuffle). Where few keys are asked for, only their rows up to the month that fills a list are ranked.
    """
    asked = cut(_per_status(plans.filter((F.col("status") == "supported") & (F.col("intent") == "select"))))
    combinations = _combinations(asked)
    if not combinations:
        return plans.limit(0).select("question_id", F.lit(1).alias("rank")).join(obs.limit(0).select(*LISTED), F.lit(False))
    first = Window.partitionBy("combination", "key").orderBy(*queries.list_order(), F.col("upload_session_id"))
    mine = cut(_plan_keys(asked, combinations).select(
        "combination", "key", "question_id", "row_limit", "dedupe",
        F.array_position("statuses", F.col("f_status")).alias("status_no")))
    asked_keys = cut(mine.select("combination", "key").distinct())
    few = asked_keys.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    # the status that a row has without its duplicates counts as asked for only where it is sure, so the bar of a key is never early
    told = obs if judged else obs.withColumn("validation_status", quality.sure_status())
    bars = cut(_leading_months(asked_keys, told, combinations)) if few else None

    def asked_rows(rows: DataFrame, only=None) -> DataFrame:
        keyed = _row_keys(_month(_dated(rows)), combinations, only=only)
        return keyed.join(F.broadcast(bars), ["combination", "key"]).filter(F.col("_month") <= F.col("bar")) if few else keyed

    def lead(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= catalog.PLAN_LIMIT_MAX)
    if judged:
        leading = lead(asked_rows(obs.select(*LISTED)))
    else:
        bare = obs.select(*[name for name in LISTED if name not in ("validation_status", "quality_flags")])
        leading = lead(_judged_rows(bare, combinations, asked_rows, lead))
    # a question asks for one key per status, so the place in the key is the place in the list of that status; what several
    # statuses list meets by question, once for both windows
    limited = mine.join(leading, ["combination", "key"]).filter(F.col("_n") <= F.col("row_limit")).select(
        "question_id", "row_limit", "dedupe", "status_no", "_n", *LISTED).repartition("question_id")
    order = [*queries.list_order(), F.col("upload_session_id")]
    same = Window.partitionBy("question_id", "upload_session_id", "source_sheet", "source_row_index",
                              "source_column").orderBy("status_no", "_n")
    unique = limited.withColumn("_d", F.row_number().over(same)).filter(~F.col("dedupe") | (F.col("_d") == 1))
    whole = Window.partitionBy("question_id").orderBy(*order)
    return (unique.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= F.col("row_limit"))
            .select("question_id", "rank", *LISTED))
