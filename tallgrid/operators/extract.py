"""Headers, data rows and labels of detected blocks.

``blocks`` come from block detection; ``cells`` are re-based block cells (artifact_id, block_id, r, col_pos,
sheet_row, kind, text) without missing values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrid import catalog as k
from tallgrid.functions import units
from tallgrid.functions import values as v
from tallgrid.operators import ranks, semantics
from tallgrid.operators.profile import BLOCK, COLUMN, cell_is_numeric
from tallgrid.operators.blocks import _is_text
from tallgrid.session import cut
from tallgrid.sources.cells import unsent

HEAD_ROWS = k.HEADER_SCAN_ROWS + k.MAX_HEADER_ROWS


def row_signals(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Header, preamble and second-header signs of the first rows of every block."""
    c = F.col
    word = F.when(_is_text(), v.strip(c("text")))
    counted = cells.filter(c("r") < HEAD_ROWS).groupBy(*BLOCK, "r").agg(
        F.count(F.lit(1)).alias("n"), F.count(word).alias("n_str"),
        F.count_if(cell_is_numeric(c("kind"), c("text"))).alias("n_num"),
        F.min(word).alias("low"), F.max(word).alias("high"))
    uniform = (c("n_str") >= 2) & F.coalesce(c("low") == c("high"), F.lit(False))
    strings, numbers = c("n_str") / c("n"), c("n_num") / c("n")
    return unsent(counted).join(blocks.select(*BLOCK, "col_count"), BLOCK).select(
        *BLOCK, "r", (c("n") / c("col_count")).alias("fill"),
        ((c("n") >= 2) & ~uniform & (strings >= 0.6) & (numbers <= 0.4)).alias("is_header"),
        ((c("n") <= 1) | uniform | (c("n") / c("col_count") <= k.PREAMBLE_FILL)).alias("is_preamble"),
        ((c("n") >= 2) & (strings >= k.SECOND_HEADER_STRINGS) & (numbers <= k.SECOND_HEADER_NUMBERS))
        .alias("is_second"))


def find_headers(blocks: DataFrame, signals: DataFrame) -> DataFrame:
    """header_start (NULL without header), header_rows and data_row_start per block."""
    c = F.col
    heads = signals.groupBy(*BLOCK).agg(F.map_from_entries(F.collect_list(F.struct(
        c("r").cast("int"), F.struct("is_header", "is_preamble", "is_second")))).alias("s"))  # eight rows at most
    known = blocks.join(heads, BLOCK, "left")
    sign = lambda i, name, missing: F.coalesce(c("s")[i][name], F.lit(missing))
    header = lambda i: sign(i, "is_header", False) & (c("row_count") > i)
    preamble = lambda i: sign(i, "is_preamble", True)
    start, lead, seen = F.when(header(0), 0), F.when(~preamble(0), 0), preamble(0)
    for i in range(1, k.HEADER_SCAN_ROWS):
        start = start.when(header(i) & seen, i)
        lead = lead.when(~preamble(i) | (c("row_count") <= i), i)
        seen = seen & preamble(i)
    lead = lead.otherwise(F.least(c("row_count"), F.lit(k.HEADER_SCAN_ROWS)))
    started = known.withColumn("header_start", start)
    second = lambda step: F.coalesce(c("s")[c("header_start") + step]["is_second"], F.lit(False)) & (
        c("row_count") > c("header_start") + step)
    rows = F.when(c("header_start").isNull(), 0).when(second(1) & second(2), 3).when(second(1), 2).otherwise(1)
    return started.withColumn("header_rows", rows).withColumn(
        "data_row_start", F.coalesce(c("header_start") + c("header_rows"), lead).cast("int")).drop("s")


def preamble_facts(headed: DataFrame, cells: DataFrame) -> DataFrame:
    """T5: unit, year and date named in the rows above the header (at most four rows)."""
    c = F.col
    above = unsent(cells.filter(c("r") < k.HEADER_SCAN_ROWS)).join(
        headed.filter("header_start > 0").select(*BLOCK, "header_start"), BLOCK).filter("r < header_start")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        _is_text(), F.struct("r", "col_pos", v.strip(c("text")).alias("w"))))), lambda s: s["w"]), " ")
    day = F.coalesce(v.parse_date(F.when(c("kind") != "num", c("text"))), F.when(_is_text(), v.dotted_date(c("text"))))
    facts = above.withColumn("day", day).groupBy(*BLOCK).agg(
        words.alias("words"), F.min_by("day", F.when(c("day").isNotNull(), F.struct("r", "col_pos"))).alias("day"))
    return facts.select(*BLOCK, units.first_token(F.lower("words"), k.PREAMBLE_UNITS).alias("table_unit"),
                        v.year_in(c("words")).alias("table_year"), c("day").alias("table_day"))


def compose_headers(headed: DataFrame, cells: DataFrame) -> DataFrame:
    """T4: one to three header rows joined per column, normalised and made unique; column_i without header."""
    c = F.col
    rows = unsent(cells.filter(c("r") < HEAD_ROWS)).join(
        headed.filter(c("header_start").isNotNull()).select(*BLOCK, "header_start", "header_rows"), BLOCK).filter(
        (c("r") >= c("header_start")) & (c("r") < c("header_start") + c("header_rows")))
    named = rows.groupBy(*COLUMN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("r", v.strip(c("text")).alias("w")))), lambda s: s["w"]), " ").alias("column"))
    every = headed.select(*BLOCK, F.explode(F.sequence(F.lit(0), c("col_count").cast("int") - 1)).alias("col_pos"))
    joined = every.join(named, COLUMN, "left").withColumn("column", v.normalize_header(c("column"), c("col_pos")))
    return v.make_unique_headers(joined, BLOCK, "column", "col_pos")


def inherit_headers(headed: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A header-less block takes headers and facts of the latest named block with its sheet and columns."""
    c = F.col
    generic = columns.groupBy(*BLOCK).agg(F.bool_and(c("column").startswith(k.GENERIC_PREFIX)).alias("generic"))
    marked = headed.join(generic, BLOCK)
    anchor = F.when((c("header_rows") > 0) & ~c("generic"),
                    F.struct("block_id", "table_unit", "table_year", "table_day"))
    order = (Window.partitionBy("artifact_id", "sheet_index", "col_start", "col_end").orderBy("block_no")
             .rowsBetween(Window.unboundedPreceding, -1))  # the blocks of one column span
    found = marked.withColumn("from", F.last(anchor, ignorenulls=True).over(order)).withColumn(
        "from", F.when((c("header_rows") == 0) & c("generic"), c("from")))
    taken = c("from").isNotNull()
    resolved = found.withColumns({
        "inherited_from": c("from.block_id"), "data_row_start": F.when(taken, 0).otherwise(c("data_row_start")),
        **{n: F.when(taken, c(f"from.{n}")).otherwise(c(n)) for n in ("table_unit", "table_year", "table_day")},
    }).drop("from", "generic")
    heirs = resolved.filter(c("inherited_from").isNotNull()).select("artifact_id", "block_id", "inherited_from")
    given = heirs.join(columns.select("artifact_id", c("block_id").alias("inherited_from"), "col_pos", "column"),
                       ["artifact_id", "inherited_from"]).select(*COLUMN, "column")
    own = columns.join(heirs.select(*BLOCK), BLOCK, "left_anti").select(*COLUMN, "column")
    return resolved, own.unionByName(given)


def sparse_text_columns(columns: DataFrame, cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Unnamed columns filled to 20 % at most, 80 % of it text: the common test of T6 and T8."""
    c = F.col
    unnamed = columns.filter(c("column").startswith(k.GENERIC_PREFIX)).select(*COLUMN)
    textual = _is_text() & ~v.is_numeric(c("text"))
    counted = unsent(cells).join(unnamed, COLUMN).groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n"),
                                                             F.count_if(textual).alias("n_text"))
    return counted.join(blocks.select(*BLOCK, "data_rows"), BLOCK).filter(
        (c("n") / c("data_rows") <= k.SPARSE_FILL) & (c("n_text") / c("n") >= k.SPARSE_TEXT)).select(*COLUMN)


def group_label_columns(columns: DataFrame, cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sparse text columns with two distinct labels, or one variety label beside a replicate column."""
    c = F.col
    sparse = sparse_text_columns(columns, cells, blocks)
    word = F.when(_is_text(), F.lower(v.strip(c("text"))))
    spread = unsent(cells).join(sparse, COLUMN).groupBy(*COLUMN).agg(F.min(word).alias("low"), F.max(word).alias("high"))
    labels = semantics.label_aggregates(c("text"))
    facts = cells.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in labels.items()])
    meaning = F.coalesce(semantics.header_dimension(c("column")), semantics.value_dimension(
        *[c(n) for n in ("n", "all_roman", "any_treatment", "any_variety", "n_numbered")]))
    order = Window.partitionBy(*BLOCK).orderBy("col_pos")  # the columns of one block
    known = (columns.join(unsent(facts), COLUMN, "left").fillna(0, ["n"]).withColumn("means", meaning)
             .withColumn("beside", F.lead("means").over(order)))
    several = F.coalesce(c("low") != c("high"), F.lit(False))
    alone = F.coalesce((c("beside") == "replicate") & (c("means") == "variety"), F.lit(False))
    return known.join(spread, COLUMN).filter(several | alone).select(*COLUMN)


def fill_group_labels(candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """Inside every run of non-empty rows the first label fills the blanks of a label column."""
    c = F.col
    rows = cells.groupBy(*BLOCK, "r").agg(F.min("sheet_row").alias("sheet_row"))
    runs = ranks.positions(rows, BLOCK, "r", "p").withColumn("run", c("r") - c("p"))
    labelled = unsent(cells).join(candidates, COLUMN)
    first = (labelled.join(runs.select(*BLOCK, "r", "run"), [*BLOCK, "r"]).groupBy(*COLUMN, "run")
             .agg(F.min_by(F.struct("kind", "text"), "r").alias("label")))
    filled = runs.join(first, [*BLOCK, "run"]).join(labelled.select(*COLUMN, "r"), [*COLUMN, "r"], "left_anti")
    return cells.unionByName(filled.select(*BLOCK, "r", "col_pos", "sheet_row", "label.kind", "label.text"))


def drop_annotations(columns: DataFrame, cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Descriptive labels in sparse text columns are blanked, short codes stay."""
    c = F.col
    sparse = sparse_text_columns(columns, cells, blocks).withColumn("sparse", F.lit(True))
    word = v.strip(c("text"))
    descriptive = _is_text() & (word.contains(" ") | (F.length(word) > k.LABEL_TOKEN_LENGTH))
    return unsent(cells).join(sparse, COLUMN, "left").filter(
        ~(F.coalesce("sparse", F.lit(False)) & descriptive)).drop("sparse")


def number_rows(cells: DataFrame) -> DataFrame:
    """Rows without cells are gone; the others are numbered from 1 per block."""
    rows = ranks.positions(cells.select(*BLOCK, "r").distinct(), BLOCK, "r", "row_no")
    return unsent(cells).join(rows, [*BLOCK, "r"]).select(*COLUMN, "row_no", "sheet_row", "kind", "text")


def extract_tables(blocks: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, columns, values) of all blocks."""
    c = F.col
    cells = cut(cells.select(*BLOCK, "r", "col_pos", "sheet_row", "kind", "text"))
    headed = find_headers(blocks, row_signals(blocks, cells))
    headed = cut(headed.join(preamble_facts(headed, cells), BLOCK, "left"))
    resolved, columns = inherit_headers(headed, cut(compose_headers(headed, cells)))
    resolved, columns = cut(resolved), cut(columns)
    data = unsent(cells).join(resolved.select(*BLOCK, "data_row_start"), BLOCK).filter(
        c("r") >= c("data_row_start")).drop("data_row_start")
    sized = resolved.withColumn("data_rows", c("row_count") - c("data_row_start"))
    filled = cut(fill_group_labels(cut(group_label_columns(columns, data, sized)), data))
    values = cut(number_rows(drop_annotations(columns, filled, sized)))
    rows = values.groupBy(*BLOCK).agg(F.max("row_no").alias("n_rows"))
    named_year = v.year_in(c("file_name")) if "file_name" in blocks.columns else F.lit(None).cast("int")
    described = sized.join(rows, BLOCK, "left").fillna(0, ["n_rows"]).withColumns({
        "inferred_unit": c("table_unit"), "inferred_year": F.coalesce("table_year", named_year),
        "inferred_observation_date": F.coalesce("table_day", "context_date"),
        "year_override": F.lit(None).cast("int")})
    return described, columns, values


