"""Scalar functions over texts derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions import text as x
from tallgrid.functions import units
from tallgrid.functions import values as v
from tallgrid.operators.profile import records
from tallgrid.registry.tables import table


def pick(index, options):
    """The option number ``index`` of a literal list, NULL options included."""
    return F.element_at(F.array(*[F.lit(o).cast("string") for o in options]), (index % len(options) + 1).cast("int"))


def sql_pick(index, options):
    items = ", ".join("NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options)
    return f"CAST([{items}] AS VARCHAR[])[{index} % {len(options)} + 1]"


def sql_first_token(text: str, rules) -> str:
    branches = " ".join("WHEN " + " OR ".join(f"contains({text}, '{t}')" for t in tokens) + f" THEN '{result}'"
                        for result, tokens in rules)
    return f"CASE {branches} END"


def _events(spark, sf):
    return table(spark, sf, "events")


NUMBER_TEXTS = ["1e3", "1_000", " 12.5 ", "1d", "0x10", ".5", "-3.", "", None, "abc", "1__0", "+7"]
NUMBER_VALUES = ["1000", "1000", "12.5", None, None, "0.5", "-3", None, None, None, None, "7"]
HEADERS = [" Plot ID ", "Yield t/ha", "", None, "Notes", "  Plant Height m", "Víz %"]
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "d-M-yyyy", "yyyyMMdd",
                "yyyy-MM-dd'T'HH:mm:ss", "'on 'yyyy-MM-dd"]
UNIT_TEXTS = [" T_HA", "pct", "Percent", "kg/parc", "bushel", "", None, "CM", "kg_ha", "m"]
UNIT_VALUES = ["t/ha", "%", "%", "kg/parc", None, None, None, "cm", "kg/ha", "m"]
UNIT_COLUMNS = ["yield_t_ha", "Yield (kg/ha)", "suly", "termes", "moisture", "víz", "height_cm", "height_m", "height"]
UNIT_MEASURES = ["yield", "yield", "yield", "yield", "moisture", "moisture", "plant_height", "plant_height",
                 "plant_height"]
MEASURE_HEADERS = ["n_40_b", "N_80", "ii._suly", "iv_height", "yield", "n_120_2", "vi.x", "iiii.x"]


def f05(spark, sf):
    e = _events(spark, sf)
    text = None
    for i, fmt in enumerate(DATE_FORMATS):
        shown = F.date_format("ts", fmt)
        text = F.when(F.col("event_id") % 8 == i, shown) if text is None else text.when(F.col("event_id") % 8 == i,
                                                                                       shown)
    return e.select("event_id", text.alias("shown")).withColumn(
        "day", v.parse_date(F.col("shown")).cast("string"))


F05_SQL = """SELECT event_id, shown, CAST(CASE k WHEN 7 THEN NULL
      WHEN 3 THEN CASE WHEN day(ts) <= 12 THEN make_date(year(ts), day(ts), month(ts)) ELSE CAST(ts AS DATE) END
      ELSE CAST(ts AS DATE) END AS VARCHAR) AS day
  FROM (SELECT event_id, ts, event_id % 8 AS k, CASE event_id % 8
      WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y/%m/%d') WHEN 2 THEN strftime(ts, '%d/%m/%Y')
      WHEN 3 THEN strftime(ts, '%m/%d/%Y') WHEN 4 THEN strftime(ts, '%-d-%-m-%Y') WHEN 5 THEN strftime(ts, '%Y%m%d')
      WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, 'on %Y-%m-%d') END AS shown FROM events)"""

FOLD = "replace(strip_accents(lower(text)), 'ß', 'ss')"
FOLD_DOC = f"trim(regexp_replace({FOLD}, '[^a-z0-9%/._-]+', ' ', 'g'))"
FOLD_QUESTION = f"trim(regexp_replace({FOLD}, '[^a-z0-9%/]+', ' ', 'g'))"
FOLD_ASCII = r"trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7f]', '', 'g')), '\s+', ' ', 'g'))"


def _number_texts(spark, sf):
    return _events(spark, sf).select("event_id", pick(F.col("event_id"), NUMBER_TEXTS).alias("shown"))


QUERIES = {
    "f01_is_missing": (
        lambda spark, sf: _number_texts(spark, sf).groupBy(v.is_missing(F.col("shown")).cast("int").alias("missing"))
        .agg(F.count(F.lit(1)).alias("n")),
        f"SELECT CAST(s IS NULL OR trim(s) = '' AS INTEGER) AS missing, count(*) AS n FROM (SELECT "
        f"{sql_pick('event_id', NUMBER_TEXTS)} AS s FROM events) GROUP BY 1"),
    "f02_normalize_header": (
        lambda spark, sf: _events(spark, sf).select("event_id", v.normalize_header(
            pick(F.col("event_id"), HEADERS), F.col("user_id")).alias("header")),
        f"SELECT event_id, coalesce(nullif(replace(lower(trim(s)), ' ', '_'), ''), 'column_' || (user_id + 1)) AS "
        f"header FROM (SELECT event_id, user_id, {sql_pick('event_id', HEADERS)} AS s FROM events)"),
    "f04_rows_to_records": (
        lambda spark, sf: _records(spark, sf),
        "SELECT CAST(event_id AS BIGINT) AS row_no, 'event_type=' || event_type || ',user=' || user_id AS record "
        "FROM events"),
    "f05_parse_date": (f05, F05_SQL),
    "f06_is_numeric": (
        lambda spark, sf: _number_texts(spark, sf).select("event_id", v.is_numeric(F.col("shown")).cast("int")
                                                          .alias("is_number")),
        "SELECT event_id, CAST(s IS NOT NULL AS INTEGER) AS is_number FROM (SELECT event_id, "
        f"{sql_pick('event_id', NUMBER_VALUES)} AS s FROM events)"),
    "f07_to_numeric": (
        lambda spark, sf: _number_texts(spark, sf).select("event_id", v.to_numeric(F.col("shown")).alias("number")),
        f"SELECT event_id, CAST({sql_pick('event_id', NUMBER_VALUES)} AS DOUBLE) AS number FROM events"),
    "f08_is_textual": (
        lambda spark, sf: _number_texts(spark, sf).select(
            "event_id", F.coalesce(v.is_textual(F.col("shown")), F.lit(False)).cast("int").alias("is_text")),
        "SELECT event_id, CAST(s IS NOT NULL AND trim(s) <> '' AND n IS NULL AS INTEGER) AS is_text FROM (SELECT "
        f"event_id, {sql_pick('event_id', NUMBER_TEXTS)} AS s, {sql_pick('event_id', NUMBER_VALUES)} AS n FROM events)"),
    "f09_serialize_cell": (
        lambda spark, sf: _events(spark, sf).select("event_id", v.serialize_cell(
            pick(F.col("event_id"), ["date", "bool", "str"]), F.col("event_type"), F.col("value"),
            F.col("ts").cast("date"), F.col("value") > 10).alias("shown")),
        "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) WHEN 1 THEN CASE WHEN "
        "value > 10 THEN 'True' ELSE 'False' END ELSE event_type END AS shown FROM events"),
    "f10_range_label": (
        lambda spark, sf: _events(spark, sf).select("event_id", v.range_label(
            F.col("event_id") + 1, F.col("event_id") + 5, F.col("user_id") + 1, F.col("event_id") + 1).alias("label")),
        "WITH letters AS (SELECT event_id, user_id + 1 AS a, event_id + 1 AS b FROM events), " + ", ".join(
            f"""l{c} AS (SELECT event_id, CASE WHEN {c} > 702 THEN chr(CAST(65 + (((({c} - 1) // 26) - 1) // 26 - 1)
            % 26 AS INTEGER)) ELSE '' END || CASE WHEN {c} > 26 THEN chr(CAST(65 + ((({c} - 1) // 26) - 1) % 26 AS
            INTEGER)) ELSE '' END || chr(CAST(65 + ({c} - 1) % 26 AS INTEGER)) AS t FROM letters)""" for c in "ab")
        + " SELECT event_id, la.t || (event_id + 1) || ':' || lb.t || (event_id + 5) AS label FROM la JOIN lb USING "
          "(event_id)"),
    "f11_year_in": (
        lambda spark, sf: _events(spark, sf).select("event_id", v.year_in(F.concat(
            pick(F.col("event_id"), ["trial ", "x1", "no_"]), (F.col("event_id") % 150 + 1880).cast("string"),
            F.lit(" plots"))).cast("string").alias("year")),
        "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 150 + 1880 >= 1900 THEN CAST(event_id % 150 + "
        "1880 AS VARCHAR) END AS year FROM events"),
    "f12_dotted_date": (
        lambda spark, sf: _events(spark, sf).select("event_id", v.dotted_date(F.concat(
            F.lit("sown "), F.date_format("ts", "yyyy. MM. d"), pick(F.col("event_id"), ["-6.", ".", "th"])))
            .cast("string").alias("day")),
        "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events"),
    "f13_normalize_unit": (
        lambda spark, sf: _events(spark, sf).select("event_id", units.normalize_unit(
            pick(F.col("event_id"), UNIT_TEXTS)).alias("unit")),
        f"SELECT event_id, {sql_pick('event_id', UNIT_VALUES)} AS unit FROM events"),
    "f15_infer_unit": (
        lambda spark, sf: _events(spark, sf).select("event_id", units.infer_unit(
            pick(F.col("event_id"), UNIT_COLUMNS), pick(F.col("event_id"), UNIT_MEASURES)).alias("unit")),
        "SELECT event_id, CASE m WHEN 'yield' THEN " + sql_first_token("c", catalog.UNIT_TOKENS["yield"])
        + " WHEN 'moisture' THEN '%' ELSE " + sql_first_token("c", catalog.UNIT_TOKENS["plant_height"])
        + f" END AS unit FROM (SELECT event_id, lower({sql_pick('event_id', UNIT_COLUMNS)}) AS c, "
          f"{sql_pick('event_id', UNIT_MEASURES)} AS m FROM events)"),
    "f17_measure_column_meta": (
        lambda spark, sf: _events(spark, sf).select("event_id", *[
            e.alias(n) for n, e in v.measure_column_meta(pick(F.col("event_id"), MEASURE_HEADERS),
                                                         F.lit(None).cast("string")).items()]),
        "SELECT event_id, {} AS meaning, {} AS treatment, {} AS replicate_column_code, {} AS replicate FROM events"
        .format(*[sql_pick("event_id", o) for o in (
            ["yield", "yield", None, None, None, "yield", None, None],
            ["n_40", "n_80", None, None, None, "n_120", None, None],
            ["b", None, None, None, None, "2", None, None],
            [None, None, "II.", "IV.", None, None, "VI.", None])])),
    "f18_allowed_or_null": (
        lambda spark, sf: _events(spark, sf).select("event_id", v.allowed_or_null(
            pick(F.col("event_id"), [" yield ", "YIELD", "moisture", "", None, "height"]), catalog.MEASURES)
            .alias("measure")),
        f"SELECT event_id, {sql_pick('event_id', ['yield', None, 'moisture', None, None, None])} AS measure FROM "
        "events"),
    "f19_fold_question": (
        lambda spark, sf: table(spark, sf, "conversations").select(
            "conv_id", "turn", x.fold_question(F.col("text")).alias("folded")),
        f"SELECT conv_id, turn, {FOLD_QUESTION} AS folded FROM conversations"),
    "f19_fold_document": (
        lambda spark, sf: table(spark, sf, "documents").select("doc_id", x.fold_document(F.col("text")).alias("folded")),
        f"SELECT doc_id, {FOLD_DOC} AS folded FROM documents"),
    "f20_fold_ascii": (
        lambda spark, sf: table(spark, sf, "documents").select("doc_id", x.fold_ascii(F.col("text")).alias("folded")),
        f"SELECT doc_id, {FOLD_ASCII} AS folded FROM documents"),
    "f21_tokenize": (
        lambda spark, sf: table(spark, sf, "documents").select(
            "doc_id", F.explode(x.tokens(x.fold_document(F.col("text")))).alias("token")),
        f"SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(string_split({FOLD_DOC}, ' ')) AS token FROM "
        "documents) WHERE len(token) >= 2"),
    "f22_snippet": (
        lambda spark, sf: table(spark, sf, "documents").select("doc_id", x.snippet(
            F.col("text"), F.array(F.lit("ation"), F.lit("zz"), F.col("lang"))).alias("snippet")),
        r"""WITH c AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents),
            f AS (SELECT doc_id, text, list_min(list_filter([instr(folded, 'ation'), instr(folded, 'zz'),
              instr(folded, lang)], lambda p: p > 0)) - 1 AS hit FROM (SELECT *, """ + FOLD_DOC + r""" AS folded FROM c)),
            s AS (SELECT *, greatest(hit - 40, 0) AS start, least(greatest(hit - 40, 0) + 220, len(text)) AS stop FROM f)
            SELECT doc_id, CASE WHEN hit IS NULL OR len(text) <= 220 THEN substr(text, 1, 220) ELSE
              CASE WHEN start > 0 THEN '...' ELSE '' END || trim(substr(text, start + 1, 220)) ||
              CASE WHEN stop < len(text) THEN '...' ELSE '' END END AS snippet FROM s"""),
    "f23_json_field": (
        lambda spark, sf: _events(spark, sf).select(
            "event_id", F.from_json("props", "map<string,string>")["k"].alias("k")),
        "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "f26_format_counter": (
        lambda spark, sf: _events(spark, sf).groupBy("user_id", F.col("event_type").alias("k"))
        .agg(F.count(F.lit(1)).alias("n")).groupBy("user_id")
        .agg(x.join_counts(F.collect_list(F.struct("k", "n"))).alias("counts")),
        "SELECT user_id, string_agg(event_type || '=' || n, ', ' ORDER BY event_type) AS counts FROM (SELECT user_id, "
        "event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"),
    "f27_display": (
        lambda spark, sf: _events(spark, sf).select(
            "event_id",
            x.format_metric(pick(F.col("event_id"), ["12.5", "", None]), pick(F.col("event_id"), ["kg", None])).alias("metric"),
            x.join_sentences(F.array(F.col("event_type"), F.lit(" two.. "), F.lit(" "), F.lit(None).cast("string")))
            .alias("sentences")),
        "SELECT event_id, coalesce(nullif(a, ''), 'n/a') || CASE WHEN b IS NULL THEN '' ELSE ' ' || b END AS metric, "
        f"event_type || '. two.' AS sentences FROM (SELECT event_id, event_type, {sql_pick('event_id', ['12.5', '', None])} "
        f"AS a, {sql_pick('event_id', ['kg', None])} AS b FROM events)"),
    "f28_metadata_text": (
        lambda spark, sf: table(spark, sf, "documents").select("doc_id", x.metadata_text(
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("metadata")),
        "SELECT doc_id, 'lang ' || lang || ' source ' || source AS metadata FROM documents"),
    "f29_public_fields": (
        lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.array_join(F.map_keys(x.public_fields(
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("_cells"), F.col("source"), F.col("source"), F.col("lang")))),
            ",").alias("kept")),
        "SELECT doc_id, 'lang,' || source AS kept FROM documents"),
}


def _records(spark, sf):
    base = _events(spark, sf).select(F.lit("a").alias("artifact_id"), F.lit("S1_B1").alias("block_id"),
                                     F.col("event_id").alias("row_no"), "event_type",
                                     F.col("user_id").cast("string").alias("user"))
    cells = base.select("artifact_id", "block_id", "row_no", F.posexplode(F.array("event_type", "user"))
                        .alias("col_pos", "text"))
    columns = spark.createDataFrame([("a", "S1_B1", 0, "event_type"), ("a", "S1_B1", 1, "user")],
                                    "artifact_id string, block_id string, col_pos int, column string")
    return records(cells, columns).select("row_no", F.array_join(F.transform(
        F.map_entries("record"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("record"))
