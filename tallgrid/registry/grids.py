"""Sheets derived from the driver tables: files, cells, blocks and table extraction.

Every supplier is a sheet whose layout follows from its key, so that the expected boxes have a closed form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallgrid.operators import blocks as b
from tallgrid.operators import components, extract
from tallgrid.operators import ingest as ing
from tallgrid.registry.tables import OBS_SQL, observations, raw_observations, table, validated
from tallgrid.registry.scalars import pick
from tallgrid.session import cut, ensure_checkpoint_dir
from tallgrid.sources import delimited, golden, store
from tallgrid.sources import cells as cl
from tallgrid.sources.cells import SHEET

# layout: (rows, columns, filled) with filled as SQL over r, c
LAYOUTS = [
    (60, 24, "r NOT IN (20, 41) AND c NOT IN (7, 8)"),        # six separate tables
    (35, 10, "c <> 5 OR r IN (3, 20)"),                         # two tables joined by a label column
    (30, 24, "r <> 14 OR c = 3"),                               # two tables joined by one cell
    (200, 10, "c <> 5 OR (r > 2 AND r % 25 = 0)"),              # two tables joined by a sparse numeric column
]
BOXES = [  # expected boxes per layout: (r0, r1, c0, c1)
    [(0, 19, 0, 6), (0, 19, 9, 23), (21, 40, 0, 6), (21, 40, 9, 23), (42, 59, 0, 6), (42, 59, 9, 23)],
    [(0, 34, 0, 4), (0, 34, 6, 9)],
    [(0, 13, 0, 23), (15, 29, 0, 23)],
    [(0, 199, 0, 4), (0, 199, 6, 9)],
]
WHOLE = [BOXES[0], [(0, 34, 0, 9)], [(0, 29, 0, 23)], [(0, 199, 0, 9)]]
STITCHED = [[(0, 59, 0, 6), (0, 59, 9, 23)], BOXES[1], [(0, 13, 0, 23), (15, 29, 0, 23)], BOXES[3]]


def grid_cells(spark, sf):
    c = F.col
    size = lambda i: F.element_at(F.array(*[F.lit(layout[i]) for layout in LAYOUTS]), (c("s_suppkey") % 4 + 1).cast("int"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a supplier becomes a thousand cells
    spread = (table(spark, sf, "supplier").repartition(tasks, "s_suppkey")
              .select("s_suppkey", "s_nationkey", size(0).alias("rows"), size(1).alias("cols"))
              .withColumn("r", F.explode(F.sequence(F.lit(0), c("rows") - 1)))
              .withColumn("c", F.explode(F.sequence(F.lit(0), c("cols") - 1))))
    filled = F.coalesce(*[F.when(c("s_suppkey") % 4 == i, F.expr(layout[2])) for i, layout in enumerate(LAYOUTS)])
    label = (c("r") == 0) | ((c("s_suppkey") % 4 == 1) & (c("c") == 5))
    return spread.filter(filled).select(
        c("s_suppkey").cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"),
        c("r").cast("long").alias("row_idx"), c("c").cast("long").alias("col_idx"),
        F.when(label, "str").otherwise("num").alias("kind"),
        F.when(c("r") == 0, F.concat(F.lit("h"), c("c").cast("string"))).when(label, F.lit("N0"))
        .otherwise((c("r") * c("c") + c("s_nationkey")).cast("string")).alias("text"))


def grid_sheets(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"),
        F.col("s_name").alias("sheet_name"))


def _boxes_sql(boxes) -> str:
    rows = ", ".join(f"({i}, {', '.join(map(str, box))})" for i, group in enumerate(boxes) for box in group)
    return f"WITH expected(layout, r0, r1, c0, c1) AS (VALUES {rows}) SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, " \
           "r0, r1, c0, c1 FROM supplier JOIN expected ON s_suppkey % 4 = layout"


def whole_boxes(spark, sf):
    return components.component_boxes(grid_cells(spark, sf).select(*SHEET, "row_idx", "col_idx"), SHEET)


def _extents(df):
    return df.select("artifact_id", *b.EXTENT)


def _axes(spark, sf, along):
    grid = cut(grid_cells(spark, sf))
    boxes = cut(b.meaningful(components.component_boxes(grid.select(*SHEET, "row_idx", "col_idx"), SHEET), grid))
    inside = cut(b.cells_in(boxes, grid))
    return boxes, inside, b.axis_counts(boxes, inside, along)


def _cut_rects(rects):
    return rects.select("artifact_id", *b.RECT)


def _vertical(spark, sf):
    _, inside, axis = _axes(spark, sf, "col")
    return _cut_rects(b.vertical_cut(cut(axis), inside))


def _horizontal(spark, sf):
    return _cut_rects(b.horizontal_cut(cut(_axes(spark, sf, "row")[2])))


def _soft(spark, sf):
    boxes, inside, columns = _axes(spark, sf, "col")
    rows = b.axis_counts(boxes, inside, "row")
    return _cut_rects(b.soft_split(boxes, cut(columns), cut(rows)))


def _refined(spark, sf):
    return b.refined_boxes(cut(grid_cells(spark, sf)))


def _order_boxes(spark, sf):
    """Boxes from order lines, overlapping in chains, for the overlap merge."""
    c = F.col
    return table(spark, sf, "lineitem").select(
        (c("l_suppkey") % 50).cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"),
        (c("l_partkey") * 10).alias("r0"), (c("l_partkey") * 10 + c("l_linenumber") * 2).alias("r1"),
        F.lit(0).cast("long").alias("c0"), (c("l_linenumber") % 3).cast("long").alias("c1")).distinct()


# --- a block below a title, a header line and a label column -------------------------------------------------------
def context_cells(spark, sf):
    """Title with a date in row 0, group header in row 2, data in rows 4-23 of columns 1-6, labels in column 0."""
    c = F.col
    s = c("s_suppkey")
    base = table(spark, sf, "supplier")
    row = lambda r, col, kind, text: F.struct(F.lit(r).cast("long").alias("row_idx"), F.lit(col).cast("long").alias("col_idx"),
                                              F.lit(kind).alias("kind"), text.alias("text"))
    fixed = F.array_compact(F.array(
        F.when(s % 2 == 0, row(0, 3, "str", F.concat(F.lit("Sown 2017. 07. "), (s % 28 + 1).cast("string"), F.lit("-29.")))),
        *[F.when(s % 3 > 0, row(2, j, "str", F.lit(t))) for j, t in ((1, "Yield"), (2, "Yield"), (3, "Water"))],
        *[F.when(s % 5 > 0, row(r, 0, "str", F.lit(t))) for r, t in ((5, "A level"), (12, "B level"))]))
    data = F.flatten(F.transform(F.sequence(F.lit(4), F.lit(23)), lambda r: F.transform(
        F.sequence(F.lit(1), F.lit(6)), lambda j: F.struct(
            r.cast("long").alias("row_idx"), j.cast("long").alias("col_idx"), F.lit("num").alias("kind"),
            (r * j).cast("string").alias("text")))))
    return base.select(s.cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"),
                       F.explode(F.concat(fixed, data)).alias("x")).select(*SHEET, "x.*")


def context_blocks(spark, sf):
    boxes = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"),
        *[F.lit(n).cast("long").alias(e) for e, n in zip(b.EXTENT, (4, 23, 1, 6))])
    return b.number_blocks(boxes)


def _context(spark, sf):
    grid = context_cells(spark, sf)
    extended = b.extend_header_context(b.extend_left_label(context_blocks(spark, sf), grid), grid)
    return extended, b.context_dates(extended, grid)


# --- table extraction: title, two header rows, labels, an annotation column and blank rows -------------------------
def sheet_table(spark, sf):
    """One block of 24 rows and 5 columns per supplier; returns (blocks, cells).

    Rows 0-2: title with unit and year, header, second header. Data rows 3-23; row 13 is empty. Column 1 has no header
    and holds a label on the first row of both groups, column 4 has no header and holds one long remark.
    """
    c = F.col
    s = c("s_suppkey")
    cell = lambda r, j, kind, text: F.struct(r.cast("long").alias("r"), F.lit(j).alias("col_pos"), F.lit(kind).alias("kind"),
                                             text.cast("string").alias("text"))
    at = lambda r, j, text: cell(F.lit(r), j, "str", text)
    head = F.array(at(0, 0, F.concat(F.lit("Trial of "), (s % 90 + 1910).cast("string"), F.lit(" in t/ha"))),
                   at(1, 0, F.lit(" Plot ID")), at(1, 2, F.lit("Yield")), at(1, 3, F.lit("Yield")),
                   at(2, 2, F.lit("one")), at(2, 3, F.when(s % 2 == 0, "one").otherwise("two")),
                   at(4, 1, F.lit("Early")), at(15, 1, F.lit("Late")), at(9, 4, F.lit("a remark of some length")))
    data = F.flatten(F.transform(
        F.filter(F.sequence(F.lit(3), F.lit(23)), lambda r: r != 13),
        lambda r: F.array(cell(r, 0, "str", F.concat(F.lit("P"), r.cast("string"))), cell(r, 2, "num", r + s),
                          cell(r, 3, "num", r * 2))))
    cells = table(spark, sf, "supplier").select(
        s.cast("string").alias("artifact_id"), F.lit("S1_B1").alias("block_id"),
        F.explode(F.concat(head, data)).alias("x")).select(
        "artifact_id", "block_id", "x.r", "x.col_pos", (c("x.r") + 1).alias("sheet_row"), "x.kind", "x.text")
    blocks = table(spark, sf, "supplier").select(
        s.cast("string").alias("artifact_id"), F.lit("S1_B1").alias("block_id"), F.lit(1).alias("block_no"),
        F.lit(1).alias("sheet_index"), F.lit("Sheet").alias("sheet_name"), F.lit(1).alias("col_start"),
        F.lit(5).alias("col_end"), F.lit(1).alias("row_start"), F.lit(24).cast("long").alias("row_count"),
        F.lit(5).cast("long").alias("col_count"), F.lit(None).cast("date").alias("context_date"))
    return blocks, cells


def _tables(spark, sf):
    return extract.extract_tables(*sheet_table(spark, sf))


def _signals(spark, sf):
    return extract.row_signals(*sheet_table(spark, sf))


def _headed(spark, sf):
    blocks, cells = sheet_table(spark, sf)
    return extract.find_headers(blocks, extract.row_signals(blocks, cells)), cells


def stacked_tables(spark, sf):
    """The table of a supplier and below it two header-less blocks of the same columns (and one of other columns)."""
    blocks, cells = sheet_table(spark, sf)
    headed, _ = _headed(spark, sf)
    columns = extract.compose_headers(headed, cells)
    facts = headed.join(extract.preamble_facts(headed, cells), ["artifact_id", "block_id"], "left")
    names = columns.withColumn("column", F.col("column"))
    for number, end in ((2, 5), (3, 5), (4, 6)):
        block = F.lit(f"S1_B{number}")
        facts = facts.unionByName(facts.filter("block_no = 1").withColumns({
            "block_id": block, "block_no": F.lit(number), "header_start": F.lit(None).cast("int"),
            "header_rows": F.lit(0), "col_end": F.lit(end), "table_unit": F.lit(None).cast("string"),
            "table_year": F.lit(None).cast("int")}))
        names = names.unionByName(columns.withColumns({
            "block_id": block, "column": F.concat(F.lit("column_"), (F.col("col_pos") + 1).cast("string"))}))
    return extract.inherit_headers(cut(facts), cut(names))


# --- delimited text --------------------------------------------------------------------------------------------------
SEPS = [",", ";", "\t", "|"]


def delimited_lines(spark, sf):
    """Order lines as text files, one per supplier: quoted separators, quoted line breaks and blank lines included."""
    from pyspark.sql import Window
    c = F.col
    sep = pick(c("l_suppkey"), SEPS)
    per_file = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rec = table(spark, sf, "lineitem").withColumn("k", F.row_number().over(per_file) - 1)
    remark = F.concat(F.lit('"say ""'), c("l_returnflag"), F.lit('""'), sep,
                      F.when(c("k") % 7 == 0, F.lit("\nmore")).otherwise(F.lit("more")), F.lit('"'))
    record = F.concat(c("l_orderkey").cast("string"), sep, remark, sep,
                      F.when(c("k") % 5 == 0, "").otherwise(c("l_linestatus")), sep, c("l_linenumber").cast("string"))
    text = F.when(c("k") % 11 == 3, F.concat(record, F.lit("\n"))).otherwise(record)
    parts = rec.select("l_suppkey", "k", F.posexplode(F.split(text, "\n")).alias("part", "text"))
    numbered = Window.partitionBy("l_suppkey").orderBy("k", "part")
    return parts.select(c("l_suppkey").cast("string").alias("artifact_id"),
                        F.concat(F.lit("supplier "), c("l_suppkey").cast("string"),
                                 F.when(c("l_suppkey") % 4 == 2, ".tsv").otherwise(".csv")).alias("file_name"),
                        (F.row_number().over(numbered) - 1).cast("long").alias("line_no"), "text")


DELIMITED_SQL = f"""WITH rec AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber,
    l_partkey, l_quantity, l_extendedprice) - 1 AS k, [',', ';', chr(9), '|'][l_suppkey % 4 + 1] AS sep FROM lineitem),
  placed AS (SELECT *, k + CAST(coalesce(sum(CASE WHEN k % 11 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_idx FROM rec)"""


def encoded_lines(spark, sf):
    """Lines of the documents as bytes: cp1250-compatible bytes for documents of plain German letters, else UTF-8."""
    d = table(spark, sf, "documents")
    simple = F.col("text").rlike("^[\\x00-\\x7FäöüßÄÖÜ]*$") & F.col("text").rlike("[äöüß]")
    raw = lambda t: F.when(simple, F.encode(t, "ISO-8859-1")).otherwise(F.encode(t, "UTF-8")).cast("string")
    lines = d.select(F.col("doc_id").cast("string").alias("artifact_id"), "text", F.posexplode(F.split("text", "\n"))
                     .alias("line_no", "line"))
    return lines.select("artifact_id", F.concat("artifact_id", F.lit(".csv")).alias("file_name"),
                        F.col("line_no").cast("long").alias("line_no"), raw(F.col("line")).alias("raw"))


# --- store -------------------------------------------------------------------------------------------------------------
def _sessions(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderkey").alias("artifact_id"),
                                             F.col("o_orderdate").alias("created_at"))


def _order_artifacts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("artifact_id")).agg(
        F.when(F.col("artifact_id") % 2 == 0, F.max("l_shipdate")).alias("uploaded_at"),
        F.collect_set("l_linenumber").alias("sheet_manifest"))


def _rebuilt(spark, sf):
    """Commit all uploads, then three again: two with doubled values, replaced, and one without rows, cleared."""
    path = f"{ensure_checkpoint_dir(spark)}/observations-{uuid.uuid4().hex}"
    obs = cut(raw_observations(spark, sf))
    store.rebuild_partition(obs, path)
    store.rebuild_partition(obs.filter(F.col("upload_session_id").isin("u1", "u2"))
                            .withColumn("value", F.col("value") * 2), path, ["u1", "u2", "u3"])
    return spark.read.parquet(path).groupBy("upload_session_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _committed_validated(spark, sf):
    """Normalise, flag and judge all observations and commit them: the whole write path."""
    path = f"{ensure_checkpoint_dir(spark)}/observations-{uuid.uuid4().hex}"
    store.rebuild_partition(validated(spark, sf), path)
    return spark.read.parquet(path).groupBy("upload_session_id", "validation_status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("quality_flags", "duplicate_candidate")).alias("n_duplicates"))


def _written_files(spark, sf, whole):
    """The suppliers of every nation written as a text file of its own, then registered."""
    path = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    (table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.concat_ws(",", "s_suppkey", "s_name").alias("line"))
     .repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").select("s_nationkey", "line")
     .write.partitionBy("s_nationkey").text(path))
    nation = F.regexp_extract("artifact_id", "s_nationkey=([0-9]+)", 1).cast("int")
    return delimited.register_artifacts(spark, path, whole).select(nation.alias("s_nationkey"), "file_size_bytes", "file_hash_sha256")


FILES_SQL = """SELECT s_nationkey, CAST(strlen(body) AS BIGINT) AS file_size_bytes, sha256(body) AS file_hash_sha256 FROM (SELECT
  s_nationkey, string_agg(s_suppkey || ',' || s_name || chr(10), '' ORDER BY s_suppkey) AS body FROM supplier GROUP BY 1)"""


def _audit(spark, sf):
    e = table(spark, sf, "events")
    return store.with_fingerprint(e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("correlation_id"),
                                           F.col("event_type").alias("tool"), F.col("props").alias("statement")))


def _artifact_rules(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("artifact_id"),
        F.when(F.col("s_suppkey") % 10 == 0, "short").otherwise(F.sha2("s_name", 256)).alias("file_hash_sha256"),
        (F.col("s_nationkey") - 2).alias("file_size_bytes"))


def _legacy(spark, sf):
    c = F.col
    obs = raw_observations(spark, sf)
    dims = F.map_filter(F.create_map(F.lit("plot_id"), F.lit("old plot"), F.lit("variety"), c("variety")),
                        lambda _, value: value.isNotNull())
    return store.backfill_legacy(obs.select(
        "upload_session_id", "plot_id", F.lit(None).cast("string").alias("variety"), "treatment", "location", "value", "unit",
        F.lit(None).cast("double").alias("normalized_value"), F.lit(None).cast("string").alias("normalized_unit"),
        pick(c("source_row_index"), ["", " ", None, "warning"]).alias("validation_status"),
        F.lit(None).cast("array<string>").alias("quality_flags"), dims.alias("dimensions_json")))


def _golden(spark, sf):
    """Nation questions written as a golden file, read back with the golden schema."""
    path = f"{ensure_checkpoint_dir(spark)}/golden-{uuid.uuid4().hex}"
    made = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("Show records of "), "c_mktsegment").alias("question"),
        (F.col("c_acctbal") > 0).alias("expected_supported"), F.lit("list_records").alias("expected_intent_type"))
    golden.write_report(made, path)
    return golden.load_golden(spark, path, one_per_line=True).groupBy("question", F.col("expected_supported").cast("int").alias("supported")).agg(
        F.count(F.lit(1)).alias("n"), F.count("expected_result").alias("with_result"))


def _merged(spark, sf):
    c = F.col
    line = table(spark, sf, "lineitem")
    cells = line.groupBy(c("l_suppkey").cast("string").alias("artifact_id"), c("l_linenumber").cast("long").alias("row_idx")).agg(
        F.min("l_orderkey").cast("string").alias("text")).select(
        "artifact_id", F.lit(1).alias("sheet_index"), "row_idx", F.lit(0).alias("col_idx"), F.lit("str").alias("kind"), "text")
    files = cells.select("artifact_id").distinct()
    sheets = files.select("artifact_id", F.lit(1).alias("sheet_index"), F.lit(8).cast("long").alias("row_count"),
                          F.lit(3).alias("max_column_count"))
    ranges = files.select("artifact_id", F.lit(1).alias("sheet_index"), F.explode(F.array(*[F.struct(
        F.lit(i).alias("ord"), F.lit(r).cast("long").alias("row_start"), F.lit(r + 2).cast("long").alias("row_end"), F.lit(0)
        .alias("col_start"), F.lit(4).alias("col_end")) for i, r in enumerate((2, 4, 6, 9))])).alias("m")).select(*SHEET, "m.*")
    return cl.expand_merged(cells, sheets, ranges)


def _manifest(spark, sf):
    grid = grid_cells(spark, sf)
    sheets = grid_sheets(spark, sf).withColumn("row_count", F.lit(200)).withColumn("max_column_count", F.lit(24))
    boxes = b.meaningful(whole_boxes(spark, sf), grid)
    return cl.sheet_manifest(sheets, grid, boxes)


AXIS_COUNT = {"col": "c", "row": "r"}
GRID_SQL = "grid AS (SELECT s_suppkey AS s, r, c FROM supplier, (SELECT unnest(range(200)) AS r), (SELECT unnest(range(24)) " \
           "AS c) WHERE " + " OR ".join(f"(s_suppkey % 4 = {i} AND r < {rows} AND c < {cols} AND ({filled}))"
                                       for i, (rows, cols, filled) in enumerate(LAYOUTS)) + ")"


def _rect_sql(rects: dict) -> str:
    rows = ", ".join(f"({i}, {', '.join(map(str, box))})" for i, group in rects.items() for box in group)
    return f"WITH expected(layout, q0, q1, p0, p1) AS (VALUES {rows}) SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, q0, q1, " \
           "p0, p1 FROM supplier JOIN expected ON s_suppkey % 4 = layout"


def _committed(spark, sf):
    """Sheets of suppliers to observations in one run."""
    grid = context_cells(spark, sf)
    sheets = grid_sheets(spark, sf).withColumn("file_name", F.concat("sheet_name", F.lit(" 2019.csv")))
    shown = ing.edit(ing.preview(grid, sheets))
    return ing.commit(shown).groupBy("variable", F.col("observation_date").cast("string").alias("day"), "validation_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"))


QUERIES = {
    "s01_register_artifacts": (
        lambda spark, sf: delimited.register_artifacts(spark, sf).select("original_filename", "mime_type", "file_size_bytes",
                                                                         "file_hash_sha256", "parser_version"), None),
    "s01_digests_of_written_files": (lambda spark, sf: _written_files(spark, sf, delimited.WHOLE_FILE), FILES_SQL),
    "s01_streamed_digests": (lambda spark, sf: _written_files(spark, sf, 0), FILES_SQL),
    "s02_decode_text": (
        lambda spark, sf: delimited.decode_text(encoded_lines(spark, sf)).select("artifact_id", "line_no", "text"),
        "SELECT CAST(doc_id AS VARCHAR) AS artifact_id, pos - 1 AS line_no, parts[pos] AS text FROM (SELECT doc_id, parts, "
        "unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"),
    "s03_detect_delimiter": (
        lambda spark, sf: delimited.detect_delimiter(delimited_lines(spark, sf)).select(
            "artifact_id", F.ascii("sep").alias("sep")),
        "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS artifact_id, [44, 59, 9, 124][l_suppkey % 4 + 1] AS sep FROM lineitem"),
    "s04_delimited_to_cells": (
        lambda spark, sf: delimited.lines_to_cells(delimited_lines(spark, sf))[0].drop("sheet_index", "kind"),
        DELIMITED_SQL + """ SELECT CAST(l_suppkey AS VARCHAR) AS artifact_id, row_idx, pos - 1 AS col_idx, f[pos] AS text FROM
          (SELECT l_suppkey, row_idx, [CAST(l_orderkey AS VARCHAR), 'say "' || l_returnflag || '"' || sep || CASE WHEN k % 7 = 0
          THEN chr(10) ELSE '' END || 'more', CASE WHEN k % 5 = 0 THEN '' ELSE l_linestatus END, CAST(l_linenumber AS VARCHAR)]
          AS f, unnest(range(1, 5)) AS pos FROM placed) WHERE f[pos] <> ''"""),
    "s04_sheet_extents": (
        lambda spark, sf: delimited.lines_to_cells(delimited_lines(spark, sf))[1].select("sheet_name", "row_count",
                                                                                        "max_column_count"),
        DELIMITED_SQL + " SELECT 'supplier ' || l_suppkey AS sheet_name, count(*) + count(*) FILTER (WHERE k % 11 = 3) AS "
                        "row_count, 4 AS max_column_count FROM rec GROUP BY l_suppkey"),
    "s05_expand_merged": (
        lambda spark, sf: _merged(spark, sf).select("artifact_id", "row_idx", "col_idx", "text"),
        """WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS a, l_linenumber AS r, CAST(min(l_orderkey) AS VARCHAR) AS v FROM
          lineitem GROUP BY 1, 2) SELECT a AS artifact_id, r AS row_idx, 0 AS col_idx, v AS text FROM t WHERE r = 1
          UNION ALL SELECT a, r + dr, dc, v FROM t, (SELECT unnest(range(2)) AS dr), (SELECT unnest(range(3)) AS dc) WHERE r IN
          (2, 4, 6)"""),
    "s06_sheet_manifest": (
        lambda spark, sf: _manifest(spark, sf).select("sheet_name", "non_empty_cell_count", "detected_block_count"),
        f"WITH {GRID_SQL} SELECT s_name AS sheet_name, count(*) AS non_empty_cell_count, CASE s % 4 WHEN 0 THEN 6 ELSE 1 END "
        "AS detected_block_count FROM grid JOIN supplier ON s = s_suppkey GROUP BY s_name, s"),
    "s07_parse_warnings": (
        lambda spark, sf: cl.parse_warnings(_manifest(spark, sf).withColumns({
            "row_count": F.when(F.col("artifact_id").cast("long") % 9 == 0, 0).otherwise(F.col("row_count")),
            "detected_block_count": F.col("detected_block_count") - 1}), ["artifact_id"]).select("artifact_id", "warning"),
        "SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, CASE WHEN s_suppkey % 9 = 0 THEN 'empty_sheet:' ELSE "
        "'no_blocks_detected:' END || s_name AS warning FROM supplier WHERE s_suppkey % 9 = 0 OR s_suppkey % 4 > 0"),
    "s08_rebuild_partition": (
        _rebuilt, OBS_SQL + "SELECT upload_session_id, count(*) AS n, round(sum(value) * CASE WHEN upload_session_id IN ('u1', "
                            "'u2') THEN 2 ELSE 1 END, 2) AS total FROM obs WHERE upload_session_id <> 'u3' GROUP BY 1"),
    "s08_commit_validated": (
        _committed_validated, OBS_SQL + "SELECT upload_session_id, validation_status, count(*) AS n, count(*) FILTER (list_contains("
                                        "quality_flags, 'duplicate_candidate')) AS n_duplicates FROM obs GROUP BY 1, 2"),
    "s09_promote": (
        lambda spark, sf: store.promote(raw_observations(spark, sf).withColumn("variable", F.when(
            F.col("source_row_index") % 3 > 0, F.col("variable")).when(F.col("source_row_index") % 2 == 0, " ")))
        .groupBy("upload_session_id", "variable").agg(F.count(F.lit(1)).alias("n")),
        OBS_SQL + "SELECT upload_session_id, variable, count(*) AS n FROM obs WHERE source_row_index % 3 > 0 GROUP BY 1, 2"),
    "s11_list_sessions": (
        lambda spark, sf: store.list_sessions(_sessions(spark, sf), _order_artifacts(spark, sf), 200).select(
            "session_id", "sheet_count", F.col("created_at").cast("string").alias("created_at")),
        """SELECT o_orderkey AS session_id, coalesce(n, 0) AS sheet_count, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS
          created_at FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, CASE WHEN l_orderkey % 2 = 0
          THEN max(l_shipdate) END AS up FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey ORDER BY coalesce(up, o_orderdate)
          DESC, o_orderkey LIMIT 200"""),
    "s12_session_detail": (
        lambda spark, sf: store.session_detail(_sessions(spark, sf), _order_artifacts(spark, sf), 77).select(
            "session_id", F.array_join(F.array_sort("sheet_manifest"), ",").alias("sheets")),
        "SELECT o_orderkey AS session_id, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS sheets FROM orders "
        "LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey = 77 GROUP BY 1"),
    "s13_current_status": (
        lambda spark, sf: store.current_status(table(spark, sf, "events").select(
            F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(
                F.col("event_type") == "error", "failed").when(F.col("value") > 5, "committed").otherwise("preview_ready")
            .alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("commit_error"))),
        "SELECT user_id AS session_id, arg_max(CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 5 THEN 'committed' "
        "ELSE 'preview_ready' END, event_id) AS status, CASE WHEN arg_max(event_type, event_id) = 'error' THEN arg_max(props, "
        "event_id) END AS commit_error FROM events GROUP BY 1"),
    "s14_tail_audit": (
        lambda spark, sf: store.tail_audit(_audit(spark, sf), "7", 50),
        "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS correlation_id, event_type AS tool, props AS statement, "
        "sha256(props) AS sql_fingerprint FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 50"),
    "s15_check_constraints": (
        lambda spark, sf: store.check_constraints(
            observations(spark, sf).withColumns({
                "variable": F.when(F.col("source_row_index") % 1000 > 0, F.col("variable")),
                "source_row_index": F.col("source_row_index") - 3}),
            _artifact_rules(spark, sf), spark.range(6).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("session_id"))),
        OBS_SQL + """, moved AS (SELECT upload_session_id AS u, block_id || '|' AS b, source_row_index - 3 AS r, source_column
            AS sc, source_row_index % 1000 > 0 AS named FROM obs)
          SELECT 'primary_key' AS rule, u || '|' || b || r || '|' || sc AS key FROM moved GROUP BY u, b, r, sc HAVING
            count(*) > 1
          UNION ALL SELECT 'row_index_positive', u || '|' || b || r || '|' || sc FROM moved WHERE r <= 0
          UNION ALL SELECT 'variable_present', u || '|' || b || r || '|' || sc FROM moved WHERE NOT named
          UNION ALL SELECT 'hash_length', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 10 = 0
          UNION ALL SELECT 'size_not_negative', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey < 2
          UNION ALL SELECT 'known_session', 'u6'"""),
    "s16_backfill_legacy": (
        lambda spark, sf: _legacy(spark, sf).groupBy("plot_id", "variety", "validation_status", "normalized_unit",
                                                     F.size("quality_flags").alias("flags"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("normalized_value"), 2).alias("total")),
        OBS_SQL + "SELECT coalesce(plot_id, 'old plot') AS plot_id, variety, CASE WHEN source_row_index % 4 = 3 THEN 'warning' "
                  "ELSE 'valid' END AS validation_status, unit AS normalized_unit, 0 AS flags, count(*) AS n, round(sum(value), 2) "
                  "AS total FROM obs GROUP BY 1, 2, 3, 4"),
    "s17_load_golden": (
        _golden, "SELECT 'Show records of ' || c_mktsegment AS question, CAST(c_acctbal > 0 AS INTEGER) AS supported, count(*) AS "
                 "n, 0 AS with_result FROM customer GROUP BY 1, 2"),
    "g01_cells_in_boxes": (
        lambda spark, sf: b.cells_in(_layout_boxes(spark, sf), grid_cells(spark, sf)).groupBy("artifact_id", *b.EXTENT).agg(
            F.count(F.lit(1)).alias("n")),
        f"WITH {GRID_SQL}, x AS ({_boxes_sql(WHOLE)}) SELECT artifact_id, r0, r1, c0, c1, count(*) AS n FROM x JOIN grid ON "
        "CAST(s AS VARCHAR) = artifact_id AND r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY ALL"),
    "g02_g03_component_boxes": (lambda spark, sf: _extents(whole_boxes(spark, sf)), _boxes_sql(WHOLE)),
    "g04_meaningful": (
        lambda spark, sf: _extents(b.meaningful(_layout_boxes(spark, sf, shrink=True), grid_cells(spark, sf))),
        "SELECT * FROM (" + _boxes_sql([[(x0, x1 - 15, y0, y1) for x0, x1, y0, y1 in g] for g in WHOLE])
        + ") WHERE r1 - r0 >= 3 AND (r1 - r0 + 1) * (c1 - c0 + 1) >= 20"),
    "g05_g06_axis_counts": (
        lambda spark, sf: _axes(spark, sf, "col")[2].select("artifact_id", *b.EXTENT, "idx", "n", "dense", "sum_n"),
        f"WITH {GRID_SQL}, x AS ({_boxes_sql(WHOLE)}), n AS (SELECT artifact_id, r0, r1, c0, c1, c AS idx, count(*) FILTER "
        "(WHERE r >= r0 + 2) AS n FROM x JOIN grid ON CAST(s AS VARCHAR) = artifact_id AND r BETWEEN r0 AND r1 AND c BETWEEN "
        "c0 AND c1 GROUP BY ALL) SELECT *, CAST(n / CAST(r1 - r0 - 1 AS DOUBLE) >= 0.3 AS INTEGER) AS dense, CAST(sum(n) OVER "
        "(PARTITION BY artifact_id, r0, c0 ORDER BY idx) AS BIGINT) AS sum_n FROM n"),
    "g07_g08_vertical_cut": (_vertical, _rect_sql({1: BOXES[1]})),
    "g09_horizontal_cut": (_horizontal, _rect_sql({2: BOXES[2]})),
    "g10_g12_soft_split": (_soft, _rect_sql({2: BOXES[2], 3: BOXES[3]})),
    "g13_g15_refined_boxes": (lambda spark, sf: _extents(_refined(spark, sf)), _boxes_sql(BOXES)),
    "g16_stitch_same_span": (
        lambda spark, sf: _extents(b.stitch_same_span(_refined(spark, sf), grid_cells(spark, sf))), _boxes_sql(STITCHED)),
    "g17_merge_overlaps": (
        lambda spark, sf: _extents(b.merge_overlaps(_order_boxes(spark, sf))),
        """WITH bx AS (SELECT DISTINCT CAST(l_suppkey % 50 AS VARCHAR) AS artifact_id, l_partkey * 10 AS r0, l_partkey * 10 +
            l_linenumber * 2 AS r1, l_linenumber % 3 AS c1 FROM lineitem),
          m AS (SELECT *, max(r1) OVER (PARTITION BY artifact_id ORDER BY r0, r1, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1
            PRECEDING) AS reach FROM bx),
          g AS (SELECT *, sum(CASE WHEN r0 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY artifact_id ORDER BY r0, r1, c1 ROWS
            UNBOUNDED PRECEDING) AS k FROM m)
          SELECT artifact_id, min(r0) AS r0, max(r1) AS r1, 0 AS c0, max(c1) AS c1 FROM g GROUP BY artifact_id, k"""),
    "g18_choose_layout": (
        lambda spark, sf: _extents(b.choose_layout(_layout_like(spark, sf, 10), _layout_like(spark, sf, 32))),
        """WITH a AS (SELECT s_suppkey AS s, unnest(range(3 + s_suppkey % 2)) AS j FROM supplier)
          SELECT CAST(s AS VARCHAR) AS artifact_id, j % 3 + s % 3 + i * 12 AS r0, j % 3 + s % 3 + i * 12 + 9 AS r1, j * 5 AS c0,
            j * 5 + 3 AS c1 FROM a, (SELECT unnest(range(3)) AS i) WHERE s % 5 = 0
          UNION ALL SELECT CAST(s AS VARCHAR), j % 3 + s % 3, j % 3 + s % 3 + 31 + 0, j * 5, j * 5 + 3 FROM a WHERE s % 5 > 0"""),
    "g19_g20_context": (
        lambda spark, sf: _extents(_context(spark, sf)[0]),
        "SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, CASE WHEN s_suppkey % 3 > 0 THEN 2 ELSE 4 END AS r0, 23 AS r1, CASE "
        "WHEN s_suppkey % 5 > 0 THEN 0 ELSE 1 END AS c0, 6 AS c1 FROM supplier"),
    "g21_context_date": (
        lambda spark, sf: _context(spark, sf)[1].select("artifact_id", F.col("context_date").cast("string").alias("day")),
        "SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, CAST(make_date(2017, 7, s_suppkey % 28 + 1) AS VARCHAR) AS day FROM "
        "supplier WHERE s_suppkey % 2 = 0"),
    "g22_number_blocks": (
        lambda spark, sf: b.number_blocks(_order_boxes(spark, sf).groupBy(*SHEET, "r0", "c0").agg(
            F.max("r1").alias("r1"), F.max("c1").alias("c1"))).select("artifact_id", "r0", "block_id"),
        "SELECT CAST(a AS VARCHAR) AS artifact_id, r0, 'S1_B' || row_number() OVER (PARTITION BY a ORDER BY r0) AS block_id FROM "
        "(SELECT DISTINCT l_suppkey % 50 AS a, l_partkey * 10 AS r0 FROM lineitem)"),
    "g23_block_cells": (
        lambda spark, sf: b.block_cells(b.number_blocks(_layout_boxes(spark, sf, BOXES)), grid_cells(spark, sf)).groupBy(
            "artifact_id", "block_id").agg(F.max("r").alias("last_r"), F.max("col_pos").alias("last_col"),
                                           F.count(F.lit(1)).alias("n"), F.max("sheet_row").alias("last_row")),
        f"WITH {GRID_SQL}, x AS ({_boxes_sql(BOXES)}), m AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY r0, "
        "c0) AS k FROM x) SELECT artifact_id, 'S1_B' || k AS block_id, max(r1 - r0) AS last_r, max(c1 - c0) AS last_col, "
        "count(*) AS n, max(r1 + 1) AS last_row FROM m JOIN grid ON CAST(s AS VARCHAR) = artifact_id AND r BETWEEN r0 AND r1 "
        "AND c BETWEEN c0 AND c1 GROUP BY artifact_id, k"),
    "t01_row_signals": (
        lambda spark, sf: _signals(spark, sf).select("artifact_id", "r", *[F.col(n).cast("int").alias(n) for n in (
            "is_header", "is_preamble", "is_second")]),
        """SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, r, CAST(r = 1 OR (r = 2 AND s_suppkey % 2 = 1) AS INTEGER) AS
          is_header, CAST(r = 0 OR (r = 2 AND s_suppkey % 2 = 0) AS INTEGER) AS is_preamble, CAST(r IN (1, 2) AS INTEGER) AS
          is_second FROM supplier, (SELECT unnest(range(8)) AS r)"""),
    "t02_t03_find_header": (
        lambda spark, sf: _headed(spark, sf)[0].select("artifact_id", "header_start", "header_rows", "data_row_start"),
        "SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, 1 AS header_start, 2 AS header_rows, 3 AS data_row_start FROM supplier"),
    "t04_compose_headers": (
        lambda spark, sf: extract.compose_headers(*_headed(spark, sf)).drop("block_id"),
        "SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, j - 1 AS col_pos, ['plot_id', 'column_2', 'yield_one', CASE WHEN "
        "s_suppkey % 2 = 0 THEN 'yield_one_2' ELSE 'yield_two' END, 'column_5'][j] AS \"column\" FROM supplier, (SELECT "
        "unnest(range(1, 6)) AS j)"),
    "t05_preamble_facts": (
        lambda spark, sf: extract.preamble_facts(*_headed(spark, sf)).select("artifact_id", "table_unit", "table_year"),
        "SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, 't/ha' AS table_unit, s_suppkey % 90 + 1910 AS table_year FROM "
        "supplier"),
    "t06_t09_rows_and_labels": (
        lambda spark, sf: _tables(spark, sf)[2].select("artifact_id", "col_pos", "row_no", "sheet_row", "text"),
        """WITH rows AS (SELECT s_suppkey AS s, r, r + 1 AS sheet_row, row_number() OVER (PARTITION BY s_suppkey ORDER BY r) AS
            row_no FROM supplier, (SELECT unnest(range(3, 24)) AS r) WHERE r <> 13)
          SELECT CAST(s AS VARCHAR) AS artifact_id, 0 AS col_pos, row_no, sheet_row, 'P' || r AS text FROM rows
          UNION ALL SELECT CAST(s AS VARCHAR), 2, row_no, sheet_row, CAST(r + s AS VARCHAR) FROM rows
          UNION ALL SELECT CAST(s AS VARCHAR), 3, row_no, sheet_row, CAST(r * 2 AS VARCHAR) FROM rows
          UNION ALL SELECT CAST(s AS VARCHAR), 1, row_no, sheet_row, CASE WHEN r < 13 THEN 'Early' ELSE 'Late' END FROM rows"""),
    "t20_inherit_headers": (
        lambda spark, sf: stacked_tables(spark, sf)[1].select("artifact_id", "block_id", "col_pos", "column"),
        "SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, 'S1_B' || n AS block_id, j - 1 AS col_pos, CASE WHEN n = 4 THEN "
        "'column_' || j ELSE ['plot_id', 'column_2', 'yield_one', CASE WHEN s_suppkey % 2 = 0 THEN 'yield_one_2' ELSE "
        "'yield_two' END, 'column_5'][j] END AS \"column\" FROM supplier, (SELECT unnest(range(1, 5)) AS n), (SELECT "
        "unnest(range(1, 6)) AS j)"),
    "t20_t21_inherited_facts": (
        lambda spark, sf: stacked_tables(spark, sf)[0].select(
            "artifact_id", "block_id", "inherited_from", "table_unit", F.col("table_year").cast("string").alias("year"),
            "data_row_start"),
        "SELECT CAST(s_suppkey AS VARCHAR) AS artifact_id, 'S1_B' || n AS block_id, CASE WHEN n IN (2, 3) THEN 'S1_B1' END AS "
        "inherited_from, CASE WHEN n < 4 THEN 't/ha' END AS table_unit, CASE WHEN n < 4 THEN CAST(s_suppkey % 90 + 1910 AS "
        "VARCHAR) END AS year, CASE WHEN n IN (2, 3) THEN 0 ELSE 3 END AS data_row_start FROM supplier, (SELECT "
        "unnest(range(1, 5)) AS n)"),
    "h00_sheets_to_observations": (_committed, None),
}


def _layout_boxes(spark, sf, boxes=WHOLE, shrink=False):
    """The closed-form boxes as a table (the first rows of the tables only, when shrunk)."""
    rows = F.array(*[F.array(*[F.struct(*[F.lit(n).cast("long").alias(e) for e, n in zip(
        b.EXTENT, (x0, x1 - (15 if shrink else 0), y0, y1))]) for x0, x1, y0, y1 in group]) for group in boxes])
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"),
        F.explode(F.element_at(rows, (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("x")).select(*SHEET, "x.*")


def _layout_like(spark, sf, height):
    """Three or four parallel tables per supplier: as three stacked pieces (10 rows) or as one tall table (32 rows)."""
    c = F.col
    base = table(spark, sf, "supplier").select(
        c("s_suppkey").alias("s"), F.explode(F.sequence(F.lit(0), (2 + c("s_suppkey") % 2).cast("int"))).alias("j"))
    top = c("j") % 3 + c("s") % 3
    pieces = base.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)]))) if height == 10 else base.withColumn(
        "i", F.lit(0))
    # every fifth supplier has tall tables that end far apart
    stagger = F.when((c("s") % 5 == 0) & F.lit(height > 10), c("j") * 7).otherwise(0)
    return pieces.select(
        c("s").cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"), (top + c("i") * 12).cast("long").alias("r0"),
        (top + c("i") * 12 + height - 1 + stagger).cast("long").alias("r1"), (c("j") * 5).cast("long").alias("c0"),
        (c("j") * 5 + 3).cast("long").alias("c1"))
