"""Table blocks in sheets, for all sheets of all files together.

Boxes are rows (artifact_id, sheet_index, r0, r1, c0, c1), 0-based and inclusive; a box is identified by its extents.
Their number follows the input, so no join of boxes, bands or lines sends a side through the driver (``unsent``).
Sheets may be very tall: cells meet boxes through row buckets, and running sums along rows go through chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrid import catalog as k
from tallgrid.functions import values as v
from tallgrid.operators import components, ranks
from tallgrid.operators.profile import cell_date
from tallgrid.session import cut
from tallgrid.sources.cells import SHEET, present, unsent

EXTENT = ["r0", "r1", "c0", "c1"]
BOX = [*SHEET, *EXTENT]
ROW_BUCKET, COL_BUCKET = 512, 64


def tiled(boxes: DataFrame) -> DataFrame:
    """Every box once for each tile of ``ROW_BUCKET`` rows and ``COL_BUCKET`` columns that it touches (``_tr``, ``_tc``)."""
    across = lambda low, high, size: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))
    return boxes.withColumn("_tr", across("r0", "r1", ROW_BUCKET)).withColumn("_tc", across("c0", "c1", COL_BUCKET))


def cells_in(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """G1: the cells inside every box, by an equi-join on tiles and a test of the extents; a cell lies in one tile."""
    c = F.col
    placed = cells.withColumn("_tr", F.floor(c("row_idx") / ROW_BUCKET)).withColumn("_tc", F.floor(c("col_idx") / COL_BUCKET))
    return (tiled(boxes).join(unsent(placed), [*SHEET, "_tr", "_tc"])
            .filter(c("row_idx").between(c("r0"), c("r1")) & c("col_idx").between(c("c0"), c("c1"))).drop("_tr", "_tc"))


def meaningful(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """At least 3 rows below the first, 2 columns and 20 non-empty cells."""
    shaped = boxes.filter(f"r1 - r0 >= {k.MIN_DATA_ROWS} and c1 - c0 + 1 >= {k.MIN_BLOCK_COLS}").select(*BOX).distinct()
    return (cells_in(shaped, cells.select(*SHEET, "row_idx", "col_idx")).groupBy(*BOX)
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k.MIN_NON_EMPTY).select(*BOX))


def axis_counts(boxes: DataFrame, inside: DataFrame, along: str) -> DataFrame:
    """Per box and column (or data row) the cell count on data rows, density and running sums.

    Adds idx, n, slots (cells a full line would have), dense, soft (nearly empty), sum_n, sum_dense, sum_soft, next_n,
    next_dense, all_n, all_dense, first, last. Lines are summed inside chunks of an axis; only the chunks' totals are
    summed over a box and handed back to its lines.
    """
    c = F.col
    top = c("r0") + k.BOX_HEADER_ROWS
    low, high, position, slots = ((c("c0"), c("c1"), "col_idx", c("r1") - top + 1) if along == "col"
                                  else (top, c("r1"), "row_idx", c("c1") - c("c0") + 1))
    line = lambda df, at, n: df.select(*BOX, slots.cast("long").alias("slots"), at.cast("long").alias("idx"), F.lit(n).alias("n"))
    every = line(boxes.filter(top <= c("r1")).select(*BOX, F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("idx")),
                 c("idx"), 0)
    lines = (every.unionByName(line(inside.filter(c("row_idx") >= top), c(position), 1))
             .groupBy(*BOX, "slots", F.floor(c("idx") / ranks.CHUNK).alias("_chunk"), "idx").agg(F.sum("n").alias("n"))
             .withColumn("dense", (c("n") / c("slots") >= k.DENSE_RATIO).cast("long"))
             .withColumn("soft", (c("n") / c("slots") <= k.SOFT_RATIO).cast("long")))
    summed = ("n", "dense", "soft")
    order = Window.partitionBy(*BOX, "_chunk").orderBy("idx")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    inner = lines.select("*", *[F.sum(x).over(running).alias(f"_i_{x}") for x in summed],
                         *[F.lead(x).over(order).alias(f"_next_{x}") for x in ("n", "dense")])
    chunks = lines.groupBy(*BOX, "_chunk").agg(
        *[F.sum(x).alias(f"_t_{x}") for x in summed], *[F.min_by(x, "idx").alias(f"_head_{x}") for x in ("n", "dense")],
        F.min("idx").alias("_first"), F.max("idx").alias("_last"))
    whole = Window.partitionBy(*BOX)  # the chunks of one box
    along_box = whole.orderBy("_chunk")
    before = along_box.rowsBetween(Window.unboundedPreceding, -1)
    totals = chunks.select(
        *BOX, "_chunk", *[F.coalesce(F.sum(f"_t_{x}").over(before), F.lit(0)).alias(f"_o_{x}") for x in summed],
        *[F.lead(f"_head_{x}").over(along_box).alias(f"_then_{x}") for x in ("n", "dense")],
        *[F.sum(f"_t_{x}").over(whole).alias(f"all_{x}") for x in ("n", "dense")],
        F.min("_first").over(whole).alias("first"), F.max("_last").over(whole).alias("last"))
    return unsent(inner).join(unsent(totals), [*BOX, "_chunk"]).select(
        *BOX, "idx", "slots", "n", "dense", "soft", *[(c(f"_i_{x}") + c(f"_o_{x}")).alias(f"sum_{x}") for x in summed],
        *[F.coalesce(f"_next_{x}", f"_then_{x}").alias(f"next_{x}") for x in ("n", "dense")],
        "all_n", "all_dense", "first", "last")


def cut_bands(axis: DataFrame, near_empty: bool) -> DataFrame:
    """Candidate bands of one or two lines with enough on both sides; rows must be near-empty on their own."""
    c = F.col
    one = F.struct(F.lit(1).alias("width"), c("n").alias("cost"), c("dense").alias("own"),
                   (c("n") / c("slots")).alias("peak"))
    two = F.struct(F.lit(2).alias("width"), (c("n") + c("next_n")).alias("cost"),
                   (c("dense") + c("next_dense")).alias("own"), (F.greatest("n", "next_n") / c("slots")).alias("peak"))
    bands = axis.withColumn("b", F.explode(F.array_compact(F.array(one, F.when(c("next_n").isNotNull(), two))))).select(
        *BOX, "slots", c("idx").alias("start"), (c("idx") + c("b.width") - 1).alias("stop"), "b.*", "first", "last",
        (c("sum_n") - c("n")).alias("left_n"), (c("all_n") - c("sum_n") + c("n") - c("b.cost")).alias("right_n"),
        (c("sum_dense") - c("dense")).alias("left_dense"),
        (c("all_dense") - c("sum_dense") + c("dense") - c("b.own")).alias("right_dense"))
    wide = bands.filter((c("start") > c("first")) & (c("stop") < c("last")) & (c("left_dense") >= k.MIN_DENSE)
                        & (c("right_dense") >= k.MIN_DENSE) & (c("left_n") >= k.MIN_NON_EMPTY)
                        & (c("right_n") >= k.MIN_NON_EMPTY))
    priced = wide.withColumn("norm", c("cost") / (c("slots") * c("width"))).withColumn(
        "sparse", (c("norm") <= k.CUT_RATIO) | (c("cost") <= k.CUT_CELLS))
    return priced.filter(c("peak") <= k.SOFT_RATIO) if near_empty else priced


def label_bands(bands: DataFrame, inside: DataFrame) -> DataFrame:
    """Bands filled to 60 % at most, mostly by text with few distinct words."""
    c = F.col
    doubtful = bands.filter(~c("sparse") & (c("norm") <= k.LABEL_BAND_FILL))
    lines = doubtful.select(*BOX, "start", "stop", "cost", F.explode(F.sequence("start", "stop")).alias("idx"))
    text = F.when((c("kind") == "str") & ~v.is_numeric(c("text")), v.strip(c("text")))
    words = inside.filter(c("row_idx") >= c("r0") + k.BOX_HEADER_ROWS).select(
        *BOX, c("col_idx").cast("long").alias("idx"), text.alias("word"))
    return (lines.join(unsent(words), [*BOX, "idx"]).groupBy(*BOX, "start", "stop", "cost")
            .agg(F.count("word").alias("n_text"), F.count_distinct("word").alias("n_words"))
            .filter((c("n_text") / c("cost") >= k.LABEL_BAND_TEXT) & (c("n_words") <= k.LABEL_BAND_DISTINCT))
            .select(*BOX, "start", "stop", F.lit(True).alias("label_like")))


def best_cut(bands: DataFrame) -> DataFrame:
    return bands.groupBy(*BOX).agg(F.min_by(F.struct("start", "stop"), F.struct("cost", "norm", "width", "start"))
                                   .alias("cut"))


def _halves(cuts: DataFrame, priority: int, along: str) -> DataFrame:
    """Both sides of a cut as rectangles (q0, q1, p0, p1) of their parent box."""
    c = F.col
    before, after = c("cut.start") - 1, c("cut.stop") + 1
    rect = lambda q0, q1, p0, p1: F.struct(q0.cast("long").alias("q0"), q1.cast("long").alias("q1"),
                                           p0.cast("long").alias("p0"), p1.cast("long").alias("p1"))
    sides = (F.array(rect(c("r0"), c("r1"), c("c0"), before), rect(c("r0"), c("r1"), after, c("c1")))
             if along == "col" else
             F.array(rect(c("r0"), before, c("c0"), c("c1")), rect(after, c("r1"), c("c0"), c("c1"))))
    return cuts.select(*BOX, F.lit(priority).alias("priority"), F.explode(sides).alias("s")).select(
        *BOX, "priority", "s.*")


def vertical_cut(columns: DataFrame, inside: DataFrame) -> DataFrame:
    """G7."""
    bands = cut_bands(columns, near_empty=False)
    labelled = bands.join(unsent(label_bands(bands, inside)), [*BOX, "start", "stop"], "left")
    return _halves(best_cut(labelled.filter(F.col("sparse") | F.col("label_like"))), 1, "col")


def horizontal_cut(rows: DataFrame) -> DataFrame:
    """G9."""
    return _halves(best_cut(cut_bands(rows, near_empty=True).filter("sparse")), 2, "row")


def separator_runs(axis: DataFrame) -> DataFrame:
    """Runs of near-empty lines with at least two dense lines on both sides."""
    c = F.col
    runs = axis.filter("soft = 1").groupBy(*BOX, (c("idx") - c("sum_soft")).alias("g")).agg(
        F.min("idx").alias("start"), F.max("idx").alias("stop"), F.min("sum_dense").alias("before"),
        F.max("all_dense").alias("all_dense"))
    return runs.filter((c("before") >= k.MIN_DENSE) & (c("all_dense") - c("before") >= k.MIN_DENSE)).select(
        *BOX, "start", "stop")


def segments(boxes: DataFrame, runs: DataFrame, low: str, high: str) -> DataFrame:
    """The intervals of [low, high] between the runs; the whole interval where a box has no run."""
    c = F.col
    order = Window.partitionBy(*BOX).orderBy("start")
    between = runs.select(*BOX, (F.coalesce(F.lag("stop").over(order) + 1, c(low).cast("long"))).alias("s0"),
                          (c("start") - 1).alias("s1"))
    last = runs.groupBy(*BOX).agg((F.max("stop") + 1).alias("s0"))
    tail = boxes.join(unsent(last), BOX, "left").select(
        *BOX, F.coalesce("s0", c(low).cast("long")).alias("s0"), c(high).cast("long").alias("s1"))
    return between.unionByName(tail).filter("s0 <= s1")


def soft_split(boxes: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Row segments times column segments of every box that has a separator."""
    col_runs, row_runs = separator_runs(columns), separator_runs(rows)
    touched = boxes.join(unsent(col_runs.select(*BOX).unionByName(row_runs.select(*BOX)).distinct()), BOX, "left_semi")
    tall = segments(touched, row_runs, "r0", "r1").select(*BOX, F.col("s0").alias("q0"), F.col("s1").alias("q1"))
    wide = segments(touched, col_runs, "c0", "c1").select(*BOX, F.col("s0").alias("p0"), F.col("s1").alias("p1"))
    return tall.join(unsent(wide), BOX).select(*BOX, F.lit(3).alias("priority"), "q0", "q1", "p0", "p1")


RECT = ["q0", "q1", "p0", "p1"]


def recomponent(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """Meaningful components inside every rectangle: (sheet, q0, q1, p0, p1, r0, r1, c0, c1)."""
    areas = rects.select(*SHEET, *RECT).distinct().select("*", *[F.col(a).alias(b) for a, b in zip(RECT, EXTENT)])
    local = cells_in(areas, cells.select(*SHEET, "row_idx", "col_idx")).select(*SHEET, *RECT, "row_idx", "col_idx")
    found = components.component_boxes(local, [*SHEET, *RECT])
    return found.join(unsent(meaningful(found, cells)), BOX, "left_semi")


def split_once(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """(box, n_r0, n_r1, n_c0, n_c1): the pieces of each box, or the box itself.

    Vertical cuts come first, then horizontal ones, then soft separators; a way counts if it leaves a meaningful piece. What
    several steps read is held by the executors for this call alone; where one is lost, its share is computed again.
    """
    c, held = F.col, []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    inside = hold(cells_in(boxes, cells))
    columns, rows = hold(axis_counts(boxes, inside, "col")), hold(axis_counts(boxes, inside, "row"))
    rects = hold(reduce(DataFrame.unionByName, [
        vertical_cut(columns, inside), horizontal_cut(rows), soft_split(boxes, columns, rows)]))
    pieces = recomponent(rects, cells).select(*SHEET, *RECT, *[c(e).alias(f"n_{e}") for e in EXTENT])
    offered = rects.join(unsent(pieces), [*SHEET, *RECT])
    best = offered.groupBy(*BOX).agg(F.min("priority").alias("priority"))
    chosen = offered.join(unsent(best), [*BOX, "priority"]).select(*BOX, *[f"n_{e}" for e in EXTENT]).distinct()
    kept = boxes.join(unsent(best), BOX, "left_anti").select(*BOX, *[c(e).cast("long").alias(f"n_{e}") for e in EXTENT])
    out = cut(chosen.unionByName(kept))
    for df in held:
        df.unpersist()
    return out


def refine(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Split until nothing changes; settled boxes leave the working set, the pieces of the others are smaller than they."""
    settled, working = [], boxes.select(*BOX)
    while True:
        pieces = split_once(working, cells)
        count = F.count(F.lit(1)).over(Window.partitionBy(*BOX))  # pieces of one box
        same = reduce(lambda a, b: a & b, [F.col(e) == F.col(f"n_{e}") for e in EXTENT])
        marked = pieces.withColumn("_settled", same & (count == 1))
        new = [F.col(f"n_{e}").alias(e) for e in EXTENT]
        settled.append(marked.filter("_settled").select(*SHEET, *new))
        working = cut(marked.filter("not _settled").select(*SHEET, *new).distinct())
        if working.isEmpty():
            return reduce(DataFrame.unionByName, settled).distinct()


def stitch_same_span(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Boxes of the same columns with at most five empty rows between them become one."""
    c = F.col
    order = Window.partitionBy(*SHEET, "c0", "c1").orderBy("r0")  # the boxes of one column span
    gaps = boxes.select(*BOX).withColumn("end", F.lag("r1").over(order))
    near = gaps.filter((c("r0") - c("end") - 1).between(0, k.MAX_STITCH_GAP))
    band = near.filter(c("r0") - c("end") > 1).select(
        *SHEET, (c("end") + 1).alias("r0"), (c("r0") - 1).alias("r1"), "c0", "c1", c("r0").alias("at"))
    filled = cells_in(band, cells.select(*SHEET, "row_idx", "col_idx")).select(
        *SHEET, c("at").alias("r0"), "c0", "c1").distinct()
    joinable = near.join(unsent(filled), [*SHEET, "r0", "c0", "c1"], "left_anti").select(*BOX, F.lit(0).alias("breaks"))
    grouped = gaps.join(unsent(joinable), BOX, "left").withColumn(
        "g", F.sum(F.coalesce("breaks", F.lit(1))).over(order))
    return grouped.groupBy(*SHEET, "c0", "c1", "g").agg(
        F.min("r0").alias("r0"), F.max_by("r1", "r0").alias("r1")).select(*BOX)


def merge_overlaps(boxes: DataFrame) -> DataFrame:
    """Intersecting boxes become their common bounding box, until no two intersect.

    One sweep down the rows of a sheet parts the boxes into stacks, each a chain of overlapping rows; boxes of different stacks
    never meet. Boxes of a stack that share a column meet all along the chain and are one box. Only the others are paired.
    """
    c = F.col
    lines = cut(boxes.groupBy(*SHEET, "r0").agg(F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"),
                                                F.max("c0").alias("in0"), F.min("c1").alias("in1")))
    swept = ranks.running_max(lines, SHEET, "r0", "r1", "reach").withColumn(
        "starts", (c("reach").isNull() | (c("r0") > c("reach"))).cast("long"))
    placed = ranks.running_totals(swept, SHEET, "r0", {"stack": "starts"})
    stacks = cut(placed.groupBy(*SHEET, "stack").agg(
        F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"),
        (F.max("in0") <= F.min("in1")).alias("one")))
    settled, mixed = stacks.filter("one").select(*BOX), stacks.filter("not one").select(*SHEET, "stack")
    if mixed.isEmpty():
        return settled
    rows = placed.join(unsent(mixed), [*SHEET, "stack"], "left_semi").select(*SHEET, "r0")
    return settled.unionByName(_merge_pairs(boxes.join(unsent(rows), [*SHEET, "r0"], "left_semi")))


def _merge_pairs(boxes: DataFrame) -> DataFrame:
    """The overlap merge by rounds over intersecting pairs."""
    c = F.col
    current = cut(boxes.select(*BOX).distinct())
    while True:
        node = F.xxhash64(*EXTENT)
        spread = tiled(current.select(*BOX, node.alias("node")))
        left = spread.select(*SHEET, "_tr", "_tc", *[c(e).alias(f"l_{e}") for e in EXTENT], c("node").alias("a"))
        right = spread.select(*SHEET, "_tr", "_tc", *EXTENT, c("node").alias("b"))
        # the tile of the upper left corner that both have owns the pair, so that it comes once
        owned = (F.floor(F.greatest("l_r0", "r0") / ROW_BUCKET) == c("_tr")) & (
            F.floor(F.greatest("l_c0", "c0") / COL_BUCKET) == c("_tc"))
        edges = cut(left.join(right, [*SHEET, "_tr", "_tc"]).filter(
            "a < b and l_r0 <= r1 and r0 <= l_r1 and l_c0 <= c1 and c0 <= l_c1").filter(owned).select(*SHEET, "a", "b"))
        if edges.isEmpty():
            return current
        labels = components.label_components(edges, SHEET)
        named = current.withColumn("node", node).join(labels, [*SHEET, "node"], "left")
        current = cut(named.groupBy(*SHEET, F.coalesce("label", "node").alias("label")).agg(
            F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
            .select(*BOX))


def detect_boxes(cells: DataFrame, stitch: bool = False, refined: DataFrame | None = None) -> DataFrame:
    """Components, refinement, size filter, optional stitching and overlap merge."""
    found = refined_boxes(cells) if refined is None else refined
    return merge_overlaps(stitch_same_span(found, cells) if stitch else found)


def refined_boxes(cells: DataFrame) -> DataFrame:
    """Refined meaningful boxes. A box below the minimum size has no piece above it, so it is dropped at once."""
    start = cut(meaningful(components.component_boxes(cells.select(*SHEET, "row_idx", "col_idx"), SHEET), cells))
    return cut(meaningful(refine(start, cells), cells))


def choose_layout(plain: DataFrame, stitched: DataFrame) -> DataFrame:
    """Stitched boxes where they are fewer and three tall ones run in parallel, else the plain boxes."""
    c = F.col
    count = lambda df, name: df.groupBy(*SHEET).agg(F.count(F.lit(1)).alias(name))
    fewer = count(plain, "n").join(count(stitched, "m"), SHEET).filter("m < n").select(*SHEET)
    tall = stitched.filter(f"r1 - r0 + 1 >= {k.PARALLEL_MIN_ROWS}")
    offsets = F.array(*[F.lit(d) for d in range(-k.PARALLEL_TOLERANCE, k.PARALLEL_TOLERANCE + 1)])
    anchors = tall.select(*SHEET, *[c(e).alias(f"a_{e}") for e in EXTENT], F.explode(offsets).alias("d")).withColumn(
        "r0", c("a_r0") + c("d"))
    parallel = (anchors.join(tall, [*SHEET, "r0"]).filter(F.abs(c("a_r1") - c("r1")) <= k.PARALLEL_TOLERANCE)
                .groupBy(*SHEET, *[f"a_{e}" for e in EXTENT]).agg(F.count(F.lit(1)).alias("n"))
                .filter(c("n") >= k.PARALLEL_BLOCKS).select(*SHEET).distinct())
    swap = fewer.join(parallel, SHEET, "left_semi")
    return stitched.join(swap, SHEET, "left_semi").select(*BOX).unionByName(
        plain.join(swap, SHEET, "left_anti").select(*BOX))


def number_blocks(boxes: DataFrame) -> DataFrame:
    """block_no and block_id S{sheet}_B{n} in reading order."""
    order = Window.partitionBy(*SHEET).orderBy("r0", "c0")  # the blocks of one sheet
    return boxes.withColumn("block_no", F.row_number().over(order)).withColumn(
        "block_id", F.concat(F.lit("S"), F.col("sheet_index").cast("string"), F.lit("_B"),
                             F.col("block_no").cast("string")))


def _is_text() -> Column:
    return F.col("kind") == "str"


def extend_left_label(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Take in the column to the left when it holds a few text labels."""
    c = F.col
    strip_of = blocks.filter("c0 >= 1").select(*SHEET, "block_no", "r0", "r1", (c("c0") - 1).alias("c0"),
                                               (c("c0") - 1).alias("c1"))
    seen = cells_in(strip_of, cells).groupBy(*SHEET, "block_no", "r0", "r1").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_is_text()).alias("n_text"))
    taken = seen.filter((c("n") >= 2) & (c("n") / (c("r1") - c("r0") + 1) <= k.LEFT_LABEL_FILL)
                        & (c("n_text") / c("n") >= k.LEFT_LABEL_TEXT)).select(*SHEET, "block_no", F.lit(1).alias("_l"))
    return blocks.join(taken, [*SHEET, "block_no"], "left").withColumn(
        "c0", c("c0") - F.coalesce("_l", F.lit(0))).drop("_l").select(*blocks.columns)


def extend_header_context(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Extend up to the nearest of the five rows above with a header signal, unless the first row already has
    repeated labels."""
    c = F.col
    area = blocks.select(*SHEET, "block_no", c("r0").alias("top"), F.greatest(
        c("r0") - k.HEADER_CONTEXT_ROWS, F.lit(0)).alias("r0"), c("r0").alias("r1"), "c0", "c1")
    word = F.when(_is_text(), F.lower(v.strip(c("text"))))
    rows = cells_in(area, cells).groupBy(*SHEET, "block_no", "top", "row_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count(word).alias("n_str"), F.count_distinct(word).alias("n_words"),
        F.sum(F.length(v.strip(F.when(_is_text(), c("text"))))).alias("chars"))
    repeated = (c("n_str") >= 2) & (c("n_words") < c("n_str"))
    signal = ((c("n_str") >= 2) & (c("n_str") / c("n") >= 0.6)
              & (repeated | ((c("n_str") >= 3) & (c("chars") / c("n_str") <= 24))))
    nearest = rows.groupBy(*SHEET, "block_no").agg(
        F.coalesce(F.bool_or((c("row_idx") == c("top")) & repeated), F.lit(False)).alias("closed"),
        F.max(F.when((c("row_idx") < c("top")) & signal, c("row_idx"))).alias("up"))
    return blocks.join(nearest.filter("not closed and up is not null"), [*SHEET, "block_no"], "left").withColumn(
        "r0", F.coalesce("up", "r0")).select(*blocks.columns)


def context_dates(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """The first date in the six rows above each block, over all columns of the sheet."""
    c = F.col
    rows = F.explode(F.sequence(F.greatest(c("r0") - k.DATE_CONTEXT_ROWS, F.lit(0)), c("r0") - 1)).alias("row_idx")
    area = blocks.filter("r0 >= 1").select(*SHEET, "block_no", rows)
    day = F.coalesce(cell_date(c("kind"), c("text")), F.when(_is_text(), v.dotted_date(c("text"))))
    dates = cells.withColumn("day", day).filter(c("day").isNotNull())
    return (area.join(unsent(dates), [*SHEET, "row_idx"]).groupBy(*SHEET, "block_no")
            .agg(F.min_by("day", F.struct("row_idx", "col_idx")).alias("context_date")))


def block_cells(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells re-based to their block: artifact_id, block_id, r, col_pos, sheet_row, kind, text."""
    c = F.col
    return cells_in(blocks, cells).select(
        "artifact_id", "block_id", (c("row_idx") - c("r0")).alias("r"), (c("col_idx") - c("c0")).cast("int")
        .alias("col_pos"), (c("row_idx") + 1).alias("sheet_row"), "kind", "text")


def detect_blocks(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Blocks of all sheets with 1-based extents, range label and context date."""
    c = F.col
    grid = cut(present(cells).select(*SHEET, c("row_idx").cast("long").alias("row_idx"),
                                     c("col_idx").cast("long").alias("col_idx"), "kind", "text"))
    refined = refined_boxes(grid)
    plain, stitched = detect_boxes(grid, False, refined), detect_boxes(grid, True, refined)
    numbered = number_blocks(choose_layout(plain, stitched))
    extended = cut(extend_header_context(extend_left_label(numbered, grid), grid))
    dated = extended.join(context_dates(extended, grid), [*SHEET, "block_no"], "left")
    one = lambda name: (c(name) + 1)
    return dated.join(sheets.select(*SHEET, "sheet_name", *(["file_name"] if "file_name" in sheets.columns else [])),
                      SHEET).withColumns({
        "row_start": one("r0"), "row_end": one("r1"), "col_start": one("c0"), "col_end": one("c1"),
        "row_count": c("r1") - c("r0") + 1, "col_count": c("c1") - c("c0") + 1,
        "range": v.range_label(one("r0"), one("r1"), one("c0"), one("c1"))})
