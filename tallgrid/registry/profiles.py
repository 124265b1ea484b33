"""Column profiles, mapping rules and harmonisation over block tables derived from events and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions.values import make_unique_headers
from tallgrid.operators import harmonize, mapping, profile, quality, semantics
from tallgrid.operators.profile import BLOCK
from tallgrid.registry.scalars import pick, sql_first_token, sql_pick
from tallgrid.registry.tables import table

HEADERS = ["date", "plot_id", "yield_t_ha", "column_4", "column_5", "moisture", "column_7", "n_40_b", "field_notes",
           "column_10", "weekday"]
ROMANS = ["i.", "ii.", "iii.", "IV."]


def event_values(spark, sf):
    """Tall values: five artifacts with one block each; event 0, 5, 10 ... are rows 1, 2, 3 ... of artifact e0."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    cells = F.array(
        F.when(i % 15 == 3, F.concat(F.lit("n.d. "), text(i % 210))).otherwise(F.date_format("ts", "dd/MM/yyyy")),
        F.concat(F.lit("P"), text(F.col("user_id"))),
        F.when(i % 7 != 0, F.concat(text(i % 97), F.lit(".5"))),
        F.col("event_type"),
        F.when(i % 50 == 0, F.concat(F.lit("a longer annotation "), text(i))),
        F.when(i % 2 == 0, F.lit("wet")).otherwise(text(i % 40)),
        pick(i, ROMANS),
        text(i % 13),
        F.col("props"),
        F.lit(None).cast("string"),
        F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.lit("none")))
    return (e.select(F.concat(F.lit("e"), text(i % 5)).alias("artifact_id"), F.lit("S1_B1").alias("block_id"),
                     (F.floor(i / 5) + 1).alias("row_no"), F.posexplode(cells).alias("col_pos", "text"))
            .filter(F.col("text").isNotNull()).withColumn("kind", F.lit("str")))


def event_columns(spark, sf):
    blocks = event_blocks(spark, sf).select(*BLOCK)
    return blocks.select(*BLOCK, F.posexplode(F.array(*[F.lit(h) for h in HEADERS])).alias("col_pos", "column"))


def event_blocks(spark, sf):
    i = F.col("event_id")
    return (table(spark, sf, "events").groupBy(F.concat(F.lit("e"), (i % 5).cast("string")).alias("artifact_id"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .select("artifact_id", F.lit("S1_B1").alias("block_id"), "n_rows",
                    F.when(F.col("artifact_id") == "e1", "t/ha").alias("inferred_unit"),
                    F.when(F.col("artifact_id") == "e2", F.lit("2020-05-05").cast("date"))
                    .alias("inferred_observation_date"),
                    F.when(F.col("artifact_id") == "e3", 2019).cast("int").alias("inferred_year"),
                    F.lit(None).cast("int").alias("year_override"),
                    (F.col("n_rows") + 1).alias("row_count")))


def profiled(spark, sf):
    return profile.profile_columns(event_values(spark, sf), event_columns(spark, sf), event_blocks(spark, sf))


VALUES_SQL = f"""
wide AS (SELECT 'e' || (event_id % 5) AS artifact_id, event_id // 5 + 1 AS row_no, ts, [
    CASE WHEN event_id % 15 = 3 THEN 'n.d. ' || (event_id % 210) ELSE strftime(ts, '%d/%m/%Y') END,
    'P' || user_id,
    CASE WHEN event_id % 7 <> 0 THEN (event_id % 97) || '.5' END,
    event_type,
    CASE WHEN event_id % 50 = 0 THEN 'a longer annotation ' || event_id END,
    CASE WHEN event_id % 2 = 0 THEN 'wet' ELSE CAST(event_id % 40 AS VARCHAR) END,
    {sql_pick('event_id', ROMANS)},
    CAST(event_id % 13 AS VARCHAR),
    props,
    NULL,
    CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE 'none' END] AS cells FROM events),
vals AS (SELECT artifact_id, row_no, pos - 1 AS col_pos, cells[pos] AS text FROM wide,
         (SELECT unnest(range(1, {len(HEADERS) + 1})) AS pos) WHERE cells[pos] IS NOT NULL),
marked AS (SELECT *, regexp_full_match(trim(text), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') AS is_num,
    coalesce(try_strptime(text, '%d/%m/%Y'), try_strptime(text, '%Y-%m-%d')) IS NOT NULL AS is_date FROM vals),
blocks AS (SELECT artifact_id, count(*) AS n_rows, CASE artifact_id WHEN 'e1' THEN 't/ha' END AS inferred_unit
    FROM wide GROUP BY 1),
cols AS (SELECT artifact_id, n_rows, inferred_unit, pos - 1 AS col_pos, {HEADERS}[pos] AS header
    FROM blocks, (SELECT unnest(range(1, {len(HEADERS) + 1})) AS pos)),
agg AS (SELECT artifact_id, col_pos, count(*) AS n, count(*) FILTER (WHERE is_num) AS n_num,
    count(*) FILTER (WHERE is_date) AS n_date, count(*) AS head_n,
    count(*) FILTER (WHERE is_num) AS head_num,
    count(*) FILTER (WHERE is_date) AS head_date,
    count(*) FILTER (WHERE NOT is_num AND NOT contains(trim(text), ' ') AND len(trim(text)) <= 16) AS n_short,
    count(DISTINCT lower(trim(text))) AS n_distinct,
    bool_and(lower(trim(text)) IN {catalog.ROMAN_REPLICATES}) AS all_roman,
    bool_or({' OR '.join(f"contains(lower(trim(text)), '{t}')" for t in catalog.TREATMENT_HINTS)}) AS any_treatment,
    bool_or({' OR '.join(f"contains(' ' || lower(trim(text)) || ' ', '{t}')" for t in catalog.VARIETY_HINTS)})
      AS any_variety,
    count(*) FILTER (WHERE regexp_matches(lower(trim(text)), '^\\d+\\.\\s+\\S+')) AS n_numbered
    FROM marked GROUP BY 1, 2),
typed AS (SELECT cols.*, coalesce(n, 0) AS n, coalesce(n_num, 0) AS n_num, coalesce(n_date, 0) AS n_date,
    coalesce(n_short, 0) AS n_short, coalesce(n_distinct, 0) AS n_distinct, all_roman, any_treatment, any_variety,
    n_numbered, n_rows - coalesce(n, 0) AS missing,
    round_even((n_rows - coalesce(n, 0)) / CAST(n_rows AS DOUBLE), 3) AS missing_ratio,
    CASE WHEN coalesce(head_n, 0) = 0 THEN 'text' WHEN head_num / head_n >= 0.8 THEN 'numeric'
         WHEN head_date / head_n >= 0.6 THEN 'date' ELSE 'text' END AS suggested
    FROM cols LEFT JOIN agg USING (artifact_id, col_pos)),
issues AS (SELECT artifact_id, col_pos, string_agg(text, '|' ORDER BY first) AS examples FROM (
    SELECT *, row_number() OVER (PARTITION BY artifact_id, col_pos ORDER BY first) AS k FROM (
      SELECT artifact_id, col_pos, text, min(row_no) AS first FROM marked JOIN typed USING (artifact_id, col_pos)
      WHERE suggested = 'date' AND NOT is_date GROUP BY 1, 2, 3)) WHERE k <= 5 GROUP BY 1, 2),
known AS (SELECT typed.*, examples,
    suggested = 'text' AND header LIKE 'column\\_%' ESCAPE '\\' AND missing_ratio <= 0.35 AND n >= 3 AND (
      n_short / n >= 0.7 OR (n_distinct BETWEEN 2 AND 32 AND n_distinct / n <= 0.6)) AS like_dim,
    {sql_first_token("header", [("plot_id", catalog.PLOT_TOKENS), *catalog.DIMENSION_TOKENS.items()])} AS header_dim,
    CASE WHEN all_roman THEN 'replicate' WHEN n >= 2 AND any_treatment THEN 'treatment'
         WHEN any_variety OR n_numbered / n >= 0.5 THEN 'variety' END AS value_dim,
    coalesce({sql_first_token("header", catalog.MEASURE_TOKENS.items())},
             CASE WHEN regexp_matches(header, '^n_\\d+') THEN 'yield' END) AS header_measure
    FROM typed LEFT JOIN issues USING (artifact_id, col_pos)),
roled AS (SELECT *, coalesce(header_dim, value_dim) AS dim,
    header LIKE 'column\\_%' ESCAPE '\\' AND suggested = 'text' AND NOT like_dim
      AND coalesce(header_dim, value_dim) IS NULL AS annotation,
    CASE WHEN coalesce(header_dim, value_dim) IS NOT NULL AND suggested = 'text' THEN 'dimension'
         WHEN like_dim THEN 'dimension'
         WHEN suggested = 'date' OR {' OR '.join(f"contains(header, '{t}')" for t in catalog.DATE_TOKENS)} THEN 'date'
         WHEN header LIKE 'column\\_%' ESCAPE '\\' AND header_dim IS NULL THEN 'ignore'
         WHEN header_dim IS NOT NULL THEN 'dimension'
         WHEN suggested = 'numeric' OR header_measure IS NOT NULL THEN 'measure' ELSE 'ignore' END AS role
    FROM known),
named AS (SELECT *, CASE WHEN role = 'measure' THEN coalesce(header_measure, CASE inferred_unit WHEN 't/ha' THEN
    'yield' END) END AS measure FROM roled),
profiled AS (SELECT artifact_id, 'S1_B1' AS block_id, col_pos, header AS "column", suggested, role AS semantic_role,
    measure AS canonical_measure, CASE WHEN role = 'dimension' THEN dim END AS canonical_dimension,
    coalesce(CASE measure WHEN 'yield' THEN {sql_first_token("header", catalog.UNIT_TOKENS["yield"])}
      WHEN 'moisture' THEN '%' END, CASE WHEN measure = 'yield' THEN inferred_unit END) AS unit,
    list_filter([CASE WHEN missing_ratio >= 0.5 THEN 'high_missing' END,
      CASE WHEN annotation THEN 'annotation_like' END, CASE WHEN examples IS NOT NULL THEN 'date_parse_issue' END,
      CASE WHEN suggested = 'text' AND n > 0 AND greatest(n_num, n_date) / n >= 0.35 THEN 'ambiguous_type' END],
      lambda w: w IS NOT NULL) AS warnings, missing, n_rows AS total, missing_ratio, examples FROM named)"""

PROFILE_SQL = f"WITH {VALUES_SQL}\n"


def edits(spark, sf):
    """Edits as rows: every tenth event asks for a change of one column, the later event wins."""
    i = F.col("event_id")
    return table(spark, sf, "events").filter(F.col("value") > 5).select(
        F.concat(F.lit("e"), (i % 5).cast("string")).alias("artifact_id"), F.lit("S1_B1").alias("block_id"),
        pick(i, ["moisture", "column_5", "nope", "yield_t_ha", "date", ""]).alias("column"), i.alias("seq"),
        pick(i, ["numeric", None, "text"]).alias("type_override"),
        pick(i, ["measure", "dimension", "ignore", "date"]).alias("semantic_role"),
        pick(i, ["moisture", None, "plant_height"]).alias("canonical_measure"),
        pick(i, [None, "location"]).alias("canonical_dimension"),
        pick(i, ["%", None, "m", "kg/ha", "pct"]).alias("unit"))


EDITED_SQL = PROFILE_SQL + f""", edits AS (SELECT 'e' || (event_id % 5) AS artifact_id, event_id AS seq,
    {sql_pick('event_id', ["moisture", "column_5", "nope", "yield_t_ha", "date", ""])} AS "column",
    {sql_pick('event_id', ["numeric", None, "text"])} AS type_override,
    {sql_pick('event_id', ["measure", "dimension", "ignore", "date"])} AS semantic_role,
    {sql_pick('event_id', ["moisture", None, "plant_height"])} AS canonical_measure,
    {sql_pick('event_id', [None, "location"])} AS canonical_dimension,
    {sql_pick('event_id', ["%", None, "m", "kg/ha", "pct"])} AS unit FROM events WHERE value > 5),
  latest AS (SELECT artifact_id, "column", max(seq) AS seq FROM edits GROUP BY 1, 2),
  edited AS (SELECT p.artifact_id, p.block_id, p.col_pos, p."column", p.suggested, p.warnings, p.missing, p.total,
    p.missing_ratio, p.examples, e.type_override,
    CASE WHEN e.seq IS NULL THEN p.semantic_role ELSE e.semantic_role END AS semantic_role,
    CASE WHEN e.seq IS NULL THEN p.canonical_measure ELSE e.canonical_measure END AS canonical_measure,
    CASE WHEN e.seq IS NULL THEN p.canonical_dimension ELSE e.canonical_dimension END AS canonical_dimension,
    CASE WHEN e.seq IS NULL THEN p.unit ELSE e.unit END AS unit
    FROM profiled p LEFT JOIN (SELECT edits.* FROM edits JOIN latest USING (artifact_id, "column", seq)) e
      USING (artifact_id, "column"))"""
UNIT_NORM = "CASE unit WHEN 'pct' THEN '%' ELSE unit END"
FINAL_TYPE = "coalesce(type_override, suggested)"
BLOCK_FACTS = """, facts AS (SELECT artifact_id, n_rows, CASE artifact_id WHEN 'e2' THEN DATE '2020-05-05' END AS day,
    CASE artifact_id WHEN 'e3' THEN 2019 END AS year FROM blocks),
  undated AS (SELECT * FROM facts WHERE day IS NULL AND artifact_id NOT IN (SELECT artifact_id FROM edited WHERE
    semantic_role = 'date'))"""


def edited(spark, sf):
    return mapping.apply_edits(profiled(spark, sf), edits(spark, sf))


# the date role of every column is taken away, so that year rules have something to report
def _dateless(columns):
    return columns.withColumn("semantic_role", F.when(
        (F.col("semantic_role") == "date") & (F.col("artifact_id") != "e0"), "ignore").otherwise(F.col("semantic_role")))


DATELESS_SQL = EDITED_SQL.replace(
    "CASE WHEN e.seq IS NULL THEN p.semantic_role ELSE e.semantic_role END AS semantic_role",
    "CASE WHEN (CASE WHEN e.seq IS NULL THEN p.semantic_role ELSE e.semantic_role END) = 'date' AND p.artifact_id <> "
    "'e0' THEN 'ignore' WHEN e.seq IS NULL THEN p.semantic_role ELSE e.semantic_role END AS semantic_role")


def line_rows(spark, sf):
    """One data row per (order, line number): two artifacts-by-supplier blocks with date, dimensions and measures."""
    grouped = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[
        F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                    "l_returnflag", "l_linestatus", "l_shipdate")])
    return grouped.select("*", F.concat(F.lit("u"), (F.col("l_orderkey") % 7).cast("string")).alias("artifact_id"),
                          F.lit("S1_B1").alias("block_id"),
                          (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"))


LINE_COLUMNS = [  # header, role, measure, dimension, unit
    ("shipped", "date", None, None, None), ("plot", "dimension", None, "plot_id", None),
    ("flag", "dimension", None, "variety", None), ("tax_class", "dimension", None, None, None),
    ("status", "dimension", None, "variety", None), ("n_40_b", "measure", "yield", None, "t_ha"),
    ("ii._height", "measure", "plant_height", None, "m"), ("price", "measure", None, None, "cm"),
    ("note", "ignore", None, None, None)]


def line_values(spark, sf):
    c = F.col
    cells = F.array(
        F.when(c("l_partkey") % 9 != 0, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise("unknown"),
        F.concat(F.lit("P"), c("l_partkey").cast("string")), c("l_returnflag"),
        F.when(c("l_tax") > 0.04, "high"), F.when(c("l_partkey") % 2 == 0, c("l_linestatus")),
        F.when(c("l_suppkey") % 6 != 0, F.round(c("l_quantity")).cast("int").cast("string")),
        F.when(c("l_suppkey") % 5 == 0, "n/a").otherwise(F.round(c("l_discount") * 100).cast("int").cast("string")),
        F.floor(c("l_extendedprice")).cast("string"), F.lit("x"))
    return (line_rows(spark, sf).select("artifact_id", "block_id", "row_no", F.posexplode(cells)
                                        .alias("col_pos", "text"))
            .filter(c("text").isNotNull())
            .select("*", F.lit("str").alias("kind"), (c("row_no") + 1).alias("sheet_row")))


def line_blocks(spark, sf):
    return line_rows(spark, sf).select("artifact_id", "block_id").distinct().select(
        "*", F.lit("Lines").alias("sheet_name"), F.lit(3).alias("row_start"), F.lit(1).alias("data_row_start"),
        F.when(F.col("artifact_id") == "u1", F.lit("2001-02-03").cast("date")).alias("inferred_observation_date"),
        F.when(F.col("artifact_id") == "u2", 2002).cast("int").alias("year_override"),
        F.when(F.col("artifact_id") == "u6", "skip_summary_block").otherwise("commit_observations")
        .alias("commit_decision"))


def line_mapping(spark, sf):
    entry = F.array(*[F.struct(F.lit(i).alias("col_pos"), *[
        F.lit(value).cast("string").alias(name) for name, value in zip(
            ("column", "semantic_role", "canonical_measure", "canonical_dimension", "unit"), row)])
        for i, row in enumerate(LINE_COLUMNS)])
    return line_blocks(spark, sf).select("artifact_id", "block_id", F.explode(entry).alias("m")).select(
        "artifact_id", "block_id", "m.*")


def built(spark, sf):
    return harmonize.build_observations(line_values(spark, sf), line_mapping(spark, sf), line_blocks(spark, sf))


def _shown(df):
    dims = F.array_join(F.array_sort(F.transform(F.map_entries("dimensions_json"),
                                                 lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return df.select("upload_session_id", "block_id", "source_sheet", "source_row_index", "sheet_row", "source_column",
                     F.col("observation_date").cast("string").alias("observation_date"), "plot_id", "variety",
                     "treatment", "location", "replicate", "variable", "value", "unit", "normalized_value",
                     "normalized_unit", dims.alias("dims"))


BUILT_SQL = """
line AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q,
    min(l_extendedprice) AS e, min(l_discount) AS d, min(l_tax) AS t, min(l_returnflag) AS f, min(l_linestatus) AS st,
    min(l_shipdate) AS ship FROM lineitem GROUP BY 1, 2),
base AS (SELECT 'u' || (l_orderkey % 7) AS upload_session_id, l_orderkey * 8 + l_linenumber AS row_no, 'P' || p AS plot_id,
    CASE WHEN p % 2 = 0 THEN st ELSE f END AS variety, CASE WHEN t > 0.04 THEN 'high' END AS tax_class,
    CASE WHEN p % 9 <> 0 THEN CAST(strptime(CASE WHEN TRUE THEN strftime(ship, '%d/%m/%Y') END, '%d/%m/%Y') AS DATE)
         WHEN l_orderkey % 7 = 1 THEN DATE '2001-02-03' WHEN l_orderkey % 7 = 2 THEN DATE '2002-01-01' END AS day,
    CASE WHEN s % 6 <> 0 THEN CAST(round(q) AS DOUBLE) END AS v1,
    CASE WHEN s % 5 <> 0 THEN CAST(round(d * 100) AS DOUBLE) END AS v2, CAST(floor(e) AS DOUBLE) AS v3
    FROM line WHERE l_orderkey % 7 <> 6),
tall AS (
  SELECT *, 'n_40_b' AS source_column, 'yield' AS variable, 'n_40' AS treatment, CAST(NULL AS VARCHAR) AS replicate,
    v1 AS value, 't/ha' AS unit, round(v1 * 1000, 6) AS normalized_value,
    CASE WHEN v1 IS NOT NULL THEN 'kg/ha' END AS normalized_unit,
    ['meaning=yield', 'raw_measure_name=n_40_b', 'replicate_column_code=b', 'treatment=n_40'] AS extra FROM base
  UNION ALL SELECT *, 'ii._height', 'plant_height', NULL, 'II.', v2, 'm', round(v2 * 100, 6),
    CASE WHEN v2 IS NOT NULL THEN 'cm' END, ['meaning=plant_height', 'raw_measure_name=ii._height', 'replicate=II.']
    FROM base
  UNION ALL SELECT *, 'price', 'price', NULL, NULL, v3, 'cm', NULL, NULL, ['raw_measure_name=price'] FROM base),
built AS (SELECT upload_session_id, 'S1_B1' AS block_id, 'Lines' AS source_sheet, row_no + 3 AS source_row_index,
    row_no + 1 AS sheet_row, source_column, day AS observation_date, plot_id, variety, treatment, CAST(NULL AS VARCHAR)
    AS location, replicate, variable, value, unit, normalized_value, normalized_unit,
    array_to_string(list_sort(list_concat(extra, ['plot_id=' || plot_id, 'variety=' || variety],
      CASE WHEN tax_class IS NULL THEN [] ELSE ['tax_class=' || tax_class] END)), ';') AS dims FROM tall)"""

SHOW_PROFILE = """SELECT artifact_id, block_id, col_pos, "column", suggested, semantic_role, canonical_measure,
 canonical_dimension, unit, array_to_string(warnings, ',') AS warnings, missing, total, missing_ratio FROM profiled"""


def _profile_rows(df):
    return df.select("artifact_id", "block_id", "col_pos", "column", "suggested", "semantic_role", "canonical_measure",
                     "canonical_dimension", "unit", F.array_join("warnings", ",").alias("warnings"), "missing", "total",
                     "missing_ratio")


QUERIES = {
    "f03_make_unique_headers": (
        lambda spark, sf: make_unique_headers(table(spark, sf, "events").select(
            (F.col("event_id") % 500).alias("block"), F.floor(F.col("event_id") / 500).alias("pos"),
            F.col("event_type").alias("header")), ["block"], "header", "pos"),
        "SELECT event_id % 500 AS block, event_id // 500 AS pos, CASE WHEN k = 1 THEN event_type ELSE event_type || "
        "'_' || k END AS header FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 500, event_type ORDER BY "
        "event_id // 500) AS k FROM events)"),
    "t10_infer_types": (
        lambda spark, sf: _profile_rows(profiled(spark, sf)).select("artifact_id", "column", "suggested"),
        PROFILE_SQL + 'SELECT artifact_id, "column", suggested FROM profiled'),
    "t11_date_issues": (
        lambda spark, sf: profiled(spark, sf).filter(F.col("example_values").isNotNull()).select(
            "artifact_id", "column", F.array_join("example_values", "|").alias("examples")),
        PROFILE_SQL + 'SELECT artifact_id, "column", examples FROM profiled WHERE examples IS NOT NULL'),
    "t12_missing_summary": (
        lambda spark, sf: profiled(spark, sf).select("artifact_id", "column", "missing", "total", "missing_ratio"),
        PROFILE_SQL + 'SELECT artifact_id, "column", missing, total, missing_ratio FROM profiled'),
    "t13_t14_warnings_and_generic_dimensions": (
        lambda spark, sf: _profile_rows(profiled(spark, sf)).select("artifact_id", "column", "semantic_role",
                                                                    "warnings"),
        PROFILE_SQL + """SELECT artifact_id, "column", semantic_role, array_to_string(warnings, ',') AS warnings
          FROM profiled"""),
    "t15_value_labels": (
        lambda spark, sf: event_values(spark, sf).groupBy("artifact_id", "col_pos").agg(
            F.count(F.lit(1)).alias("n"), *[e.alias(k) for k, e in semantics.label_aggregates(F.col("text")).items()])
        .select("artifact_id", "col_pos", semantics.value_dimension(*[F.col(k) for k in (
            "n", "all_roman", "any_treatment", "any_variety", "n_numbered")]).alias("dimension")),
        PROFILE_SQL + "SELECT artifact_id, col_pos, value_dim AS dimension FROM known WHERE n > 0"),
    "t16_t17_canonical_names": (
        lambda spark, sf: event_columns(spark, sf).select(
            "artifact_id", "column", semantics.header_dimension(F.col("column")).alias("dimension"),
            semantics.header_measure(F.col("column")).alias("measure")),
        PROFILE_SQL + 'SELECT artifact_id, header AS "column", header_dim AS dimension, header_measure AS measure '
                      "FROM known"),
    "t18_t19_enriched_columns": (lambda spark, sf: _profile_rows(profiled(spark, sf)), PROFILE_SQL + SHOW_PROFILE),
    "t22_classify_block": (
        lambda spark, sf: profile.classify_blocks(profiled(spark, sf)).withColumn(
            "classification_reasons", F.array_join("classification_reasons", ";")),
        PROFILE_SQL + """, c AS (SELECT artifact_id, count(*) FILTER (WHERE semantic_role = 'measure') AS m,
            count(*) FILTER (WHERE semantic_role = 'measure' AND canonical_measure IS NOT NULL) AS cm,
            count(*) FILTER (WHERE semantic_role = 'measure' AND unit IS NOT NULL) AS mu,
            coalesce(string_agg(DISTINCT canonical_dimension, ',' ORDER BY canonical_dimension) FILTER (WHERE
              semantic_role = 'dimension'), 'none') AS dims,
            count(*) FILTER (WHERE semantic_role = 'measure' AND regexp_full_match("column", '[a-z]{1,3}')) AS weak
            FROM profiled GROUP BY 1)
          SELECT artifact_id, 'S1_B1' AS block_id, CASE WHEN m > 0 AND dims <> 'none' AND (cm > 0 OR mu > 0) THEN
            'observation_like' ELSE 'unknown' END AS semantic_classification, 'measure_columns=' || m ||
            ';canonical_measures=' || cm || ';measure_units=' || mu || ';canonical_dimensions=' || dims ||
            ';weak_measure_names=' || weak AS classification_reasons, 'commit_observations' AS commit_decision,
            CAST(NULL AS VARCHAR) AS skip_reason FROM c"""),
    "t23_preview_sample": (
        lambda spark, sf: profile.preview_sample(event_values(spark, sf)).select("artifact_id", "row_no", "col_pos",
                                                                                 "text"),
        PROFILE_SQL + "SELECT artifact_id, row_no, col_pos, text FROM vals WHERE row_no <= 25"),
    "t24_mapping_defaults": (
        lambda spark, sf: mapping.mapping_defaults(_blanked(profiled(spark, sf))).select(
            "artifact_id", "column", "semantic_role", "canonical_measure", "canonical_dimension", "unit"),
        PROFILE_SQL + f"""SELECT artifact_id, header AS "column", role AS semantic_role, CASE WHEN role = 'measure' THEN
            header_measure END AS canonical_measure, CASE WHEN role = 'dimension' THEN header_dim END AS
            canonical_dimension, CASE WHEN role = 'measure' THEN CASE header_measure WHEN 'yield' THEN
            {sql_first_token("header", catalog.UNIT_TOKENS["yield"])} WHEN 'moisture' THEN '%' END END AS unit
            FROM (SELECT *, CASE WHEN suggested = 'date' OR
            {' OR '.join(f"contains(header, '{t}')" for t in catalog.DATE_TOKENS)} THEN 'date'
            WHEN (header LIKE 'column\\_%' ESCAPE '\\' OR annotation) AND header_dim IS NULL THEN 'ignore'
            WHEN header_dim IS NOT NULL THEN 'dimension' WHEN suggested = 'numeric' OR header_measure IS NOT NULL THEN
            'measure' ELSE 'ignore' END AS role FROM roled_base)""".replace("roled_base", "(SELECT * EXCLUDE (role) FROM "
                                                                          "roled)")),
    "t25_apply_edits": (
        lambda spark, sf: edited(spark, sf).select("artifact_id", "column", "type_override", "semantic_role",
                                                   "canonical_measure", "canonical_dimension", "unit"),
        EDITED_SQL + 'SELECT artifact_id, "column", type_override, semantic_role, canonical_measure, '
                     "canonical_dimension, unit FROM edited"),
    "t26_lint_mapping": (
        lambda spark, sf: mapping.lint_mapping(edited(spark, sf)).select(
            "artifact_id", F.coalesce("column", F.lit("-")).alias("column"), "violation"),
        EDITED_SQL + f""", j AS (SELECT *, {FINAL_TYPE} AS ft, {UNIT_NORM} AS u, canonical_measure IS NOT NULL OR
            canonical_dimension IS NOT NULL OR unit IS NOT NULL AS carried FROM edited)
          SELECT artifact_id, "column", 'measure_not_numeric' AS violation FROM j WHERE semantic_role = 'measure' AND
            ft <> 'numeric'
          UNION ALL SELECT artifact_id, "column", 'dimension_on_measure' FROM j WHERE semantic_role = 'measure' AND
            canonical_dimension IS NOT NULL
          UNION ALL SELECT artifact_id, "column", 'unsupported_unit' FROM j WHERE semantic_role = 'measure' AND u IS NOT
            NULL AND canonical_measure IS NOT NULL AND NOT CASE canonical_measure WHEN 'yield' THEN u IN ('kg/ha',
            't/ha', 'kg/parc') WHEN 'moisture' THEN u = '%' ELSE u IN ('cm', 'm') END
          UNION ALL SELECT artifact_id, "column", 'date_not_date_typed' FROM j WHERE semantic_role = 'date' AND
            ft <> 'date'
          UNION ALL SELECT artifact_id, "column", 'metadata_on_date' FROM j WHERE semantic_role = 'date' AND carried
          UNION ALL SELECT artifact_id, "column", 'measure_on_dimension' FROM j WHERE semantic_role = 'dimension' AND
            (canonical_measure IS NOT NULL OR unit IS NOT NULL)
          UNION ALL SELECT artifact_id, "column", 'metadata_on_ignore' FROM j WHERE semantic_role = 'ignore' AND carried
          UNION ALL SELECT artifact_id, '-', 'several_dates' FROM j WHERE semantic_role = 'date' GROUP BY 1 HAVING
            count(*) > 1"""),
    "t27_lint_year": (
        lambda spark, sf: mapping.lint_year(_dateless(edited(spark, sf)), event_blocks(spark, sf)),
        DATELESS_SQL + BLOCK_FACTS + "SELECT artifact_id, 'S1_B1' AS block_id, 'no_year' AS violation FROM undated "
                                     "WHERE year IS NULL"),
    "t28_draft_issues": (
        lambda spark, sf: mapping.draft_issues(_dateless(edited(spark, sf)), event_blocks(spark, sf)).select(
            "artifact_id", F.coalesce("column", F.lit("-")).alias("column"), "level", "message"),
        DATELESS_SQL + BLOCK_FACTS + f""", j AS (SELECT *, {FINAL_TYPE} AS ft FROM edited)
          SELECT artifact_id, "column", 'error' AS level, 'measure_not_numeric: a measure needs numbers.' AS message FROM j
            WHERE semantic_role = 'measure' AND ft <> 'numeric'
          UNION ALL SELECT artifact_id, "column", 'warning', 'measure_unnamed: stored under the header as it stands.'
            FROM j WHERE semantic_role = 'measure' AND canonical_measure IS NULL
          UNION ALL SELECT artifact_id, "column", 'warning', 'unit_unknown: stored as given, not converted.'
            FROM j WHERE semantic_role = 'measure' AND canonical_measure IS NOT NULL AND unit IS NULL
          UNION ALL SELECT artifact_id, "column", 'warning', 'dimension_unnamed: kept under the header as it stands.'
            FROM j WHERE semantic_role = 'dimension' AND canonical_dimension IS NULL
          UNION ALL SELECT artifact_id, "column", 'error', 'date_not_dates: a date column needs dates.' FROM j WHERE
            semantic_role = 'date' AND ft <> 'date'
          UNION ALL SELECT artifact_id, "column", 'warning', 'dates_unreadable: ' ||
            replace(examples, '|', ', ') FROM j WHERE examples IS NOT NULL
          UNION ALL SELECT artifact_id, "column", 'warning', 'often_empty: ' || missing || '/' || total ||
            ' rows have no value.' FROM j WHERE missing_ratio >= 0.4
          UNION ALL SELECT artifact_id, "column", 'warning', 'reading: ' || w || '.' FROM (SELECT artifact_id,
            "column", unnest(warnings) AS w FROM j)
          UNION ALL SELECT artifact_id, '-', 'error', 'several_dates: a table has one date column at most.' FROM j
            WHERE semantic_role = 'date' GROUP BY 1 HAVING count(*) > 1
          UNION ALL SELECT artifact_id, '-', 'error', 'no_year: set a year or name a date column before the commit.'
            FROM undated WHERE year IS NULL"""),
    "t29_default_year_override": (
        lambda spark, sf: mapping.default_year_override(_dateless(edited(spark, sf)), event_blocks(spark, sf)),
        DATELESS_SQL + BLOCK_FACTS + "SELECT artifact_id, min(year) AS year_override FROM undated GROUP BY 1 HAVING "
                                     "count(DISTINCT year) = 1"),
    "t30_mapping_counts": (
        lambda spark, sf: mapping.mapping_counts(edited(spark, sf), event_blocks(spark, sf)).drop("block_id"),
        EDITED_SQL + "SELECT artifact_id, " + ", ".join(
            f"count(*) FILTER (WHERE semantic_role = '{r}') AS {r}_columns" for r in catalog.ROLES)
        + ", count(*) FILTER (WHERE len(warnings) > 0) AS warning_columns, max(total) * count(*) FILTER (WHERE "
          "semantic_role = 'measure') AS estimated_rows FROM edited GROUP BY 1"),
    "h01_h06_unpivoted_observations": (
        lambda spark, sf: _shown(built(spark, sf)),
        f"WITH {BUILT_SQL} SELECT * REPLACE (CAST(observation_date AS VARCHAR) AS observation_date) FROM built"),
    "h02_observation_dates": (
        lambda spark, sf: built(spark, sf).groupBy("upload_session_id", F.col("observation_date").cast("string")
                                                   .alias("day")).agg(F.count(F.lit(1)).alias("n")),
        f"WITH {BUILT_SQL} SELECT upload_session_id, CAST(observation_date AS VARCHAR) AS day, count(*) AS n FROM built "
        "GROUP BY 1, 2"),
    "h03_h04_dimension_payload": (
        lambda spark, sf: _shown(built(spark, sf)).groupBy("source_column", "variety", "treatment", "replicate")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dims").contains("tax_class")).alias("classed")),
        f"WITH {BUILT_SQL} SELECT source_column, variety, treatment, replicate, count(*) AS n, count(*) FILTER (WHERE "
        "contains(dims, 'tax_class')) AS classed FROM built GROUP BY 1, 2, 3, 4"),
    "h11_commit_summary": (
        lambda spark, sf: _summary(spark, sf),
        f"WITH {BUILT_SQL} SELECT upload_session_id, count(*) AS staging_rows, count(*) AS harmonized_rows FROM built "
        "GROUP BY 1"),
    "h12_committed_quality": (
        lambda spark, sf: harmonize.validate_observations(built(spark, sf)).groupBy(
            F.array_join("quality_flags", ",").alias("flags"), "validation_status", "variable")
        .agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {BUILT_SQL}, q AS (SELECT *, count(*) OVER (PARTITION BY upload_session_id, observation_date, plot_id,
          variety, treatment, variable, unit, replicate, source_column) > 1 AS dup, coalesce(CASE variable WHEN 'yield'
          THEN normalized_value > 25000 WHEN 'plant_height' THEN normalized_value > 500 END, FALSE) AS far FROM built),
          z AS (SELECT *, array_to_string(list_filter([CASE WHEN value IS NULL THEN 'missing_measure_value' END,
            CASE WHEN observation_date IS NULL THEN 'missing_observation_date' END, CASE WHEN far THEN
            'outlier_candidate' END, CASE WHEN dup THEN 'duplicate_candidate' END], lambda x: x IS NOT NULL), ',') AS
            flags FROM q)
          SELECT flags, CASE WHEN value IS NULL OR observation_date IS NULL THEN 'invalid' WHEN far OR dup THEN 'warning'
            ELSE 'valid' END AS validation_status, variable, count(*) AS n FROM z GROUP BY 1, 2, 3"""),
}


def _blanked(columns):
    """A mapping whose inferred fields are absent or invalid, as stored by an older version."""
    return columns.withColumns({
        "semantic_role": F.lit("role?"), "canonical_measure": F.lit("unknown"),
        "canonical_dimension": F.lit(None).cast("string"), "unit": F.lit("stone")})


def _summary(spark, sf):
    from tallgrid.sources import store
    staging = built(spark, sf)
    return harmonize.commit_summary(staging, store.promote(staging))
