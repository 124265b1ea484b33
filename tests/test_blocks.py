import random
from collections import deque

import pytest

from tallgrid.operators import blocks as b
from tallgrid.operators import components as comp
from tallgrid.operators import ingest, ranks
from tallgrid.sources.cells import SHEET, parse_warnings, sheet_manifest


def search(grid):
    left, out = {(i, j) for i, row in enumerate(grid) for j, x in enumerate(row) if x is not None}, []
    while left:
        queue = deque([left.pop()])
        seen = list(queue)
        while queue:
            i, j = queue.popleft()
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in left:
                    left.remove(n)
                    queue.append(n)
                    seen.append(n)
        rows, cols = [i for i, _ in seen], [j for _, j in seen]
        out.append((min(rows), max(rows), min(cols), max(cols)))
    return sorted(out)


def extents(df, artifact):
    return sorted((r.r0, r.r1, r.c0, r.c1) for r in df.filter(df.artifact_id == artifact).collect())


def test_components_equal_a_search(spark, make_cells, monkeypatch):
    generator = random.Random(7)
    noise = lambda rows, cols, share: [[1 if generator.random() < share else None for _ in range(cols)] for _ in range(rows)]
    spiral = [[None] * 9 for _ in range(9)]
    for i, j in [(0, k) for k in range(9)] + [(k, 8) for k in range(9)] + [(8, k) for k in range(9)] + \
            [(k, 0) for k in range(2, 9)] + [(2, k) for k in range(7)] + [(k, 6) for k in range(2, 7)]:
        spiral[i][j] = 1
    grids = {"a": noise(25, 30, .55), "b": noise(40, 5, .6), "c": spiral, "d": [[1] * 150] * 3}
    monkeypatch.setattr(comp, "TILE_ROWS", 4)  # components wind through many tiles
    monkeypatch.setattr(comp, "TILE_COLS", 3)
    cells, _ = make_cells(grids)
    found = comp.component_boxes(cells.select(*SHEET, "row_idx", "col_idx"), SHEET).cache()
    for name, grid in grids.items():
        assert extents(found, name) == search(grid), name


def side_by_side():
    rows = [[f"h{j}" for j in range(5)] + [None] + [f"k{j}" for j in range(4)]]
    for i in range(1, 35):
        rows.append([i * 10 + j for j in range(5)] + ["N0" if i in (3, 20) else None] + [i + j for j in range(4)])
    return rows


def stacked():
    rows = [[f"h{j}" for j in range(8)], [f"u{j}" for j in range(8)]]
    for _ in range(3):
        rows += [[i * j for j in range(1, 9)] for i in range(1, 6)] + [[None] * 8]
    return rows


def test_one_tile_takes_no_rounds(spark, make_cells, monkeypatch):
    rounds = []
    monkeypatch.setattr(comp, "label_components", lambda edges, keys: rounds.append(edges.count()))
    cells, _ = make_cells({"a": [[1, 1, None, 1], [None, 1, None, 1], [1, None, None, 1]]})
    assert extents(comp.component_boxes(cells.select(*SHEET, "row_idx", "col_idx"), SHEET), "a") == [
        (0, 1, 0, 1), (0, 2, 3, 3), (2, 2, 0, 0)]
    assert rounds == [0]


def test_refinement_runs_until_nothing_changes(make_cells):
    """A row of tables bridged pairwise by one cell each: one vertical cut a round, far more rounds than five."""
    tables = 9
    grid = []
    for i in range(14):
        row = []
        for t in range(tables):
            row += [f"h{t}{j}" if i == 0 else i * (j + 1) + t for j in range(4)]
            if t < tables - 1:
                row.append("N0" if i in (4, 9) else None)
        grid.append(row)
    cells, _ = make_cells({"wide": grid})
    assert extents(b.refined_boxes(cells), "wide") == [(0, 13, 5 * t, 5 * t + 3) for t in range(tables)]


def test_overlap_pairs_come_once_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(b, "ROW_BUCKET", 5)
    monkeypatch.setattr(b, "COL_BUCKET", 3)
    g = random.Random(8)
    boxes = sorted({(r, r + g.randrange(12), c, c + g.randrange(7)) for r, c in ((g.randrange(90), g.randrange(60)) for _ in range(120))})
    seen = []
    real = comp.label_components
    monkeypatch.setattr(comp, "label_components", lambda edges, keys: (seen.append((edges.count(), edges.distinct().count())), real(edges, keys))[1])
    got = b.merge_overlaps(spark.createDataFrame([("a", 1, *x) for x in boxes], "artifact_id string, sheet_index int, r0 long, r1 long, c0 long, c1 long"))
    want = [list(x) for x in boxes]
    while True:
        pair = next(((x, y) for i, x in enumerate(want) for y in want[:i]
                     if x[0] <= y[1] and y[0] <= x[1] and x[2] <= y[3] and y[2] <= x[3]), None)
        if pair is None:
            break
        x, y = pair
        want.remove(x)
        want.remove(y)
        want.append([min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3])])
    assert extents(got, "a") == sorted(map(tuple, want))
    overlapping = sum(x[0] <= y[1] and y[0] <= x[1] and x[2] <= y[3] and y[2] <= x[3] for i, x in enumerate(boxes) for y in boxes[:i])
    assert seen[0] == (overlapping, overlapping)


def test_splits_and_stitching(make_cells):
    cells, _ = make_cells({"side": side_by_side(), "stack": stacked(), "tiny": [[1, 2], [3, 4]]})
    refined = b.refined_boxes(cells)
    plain, stitched = b.detect_boxes(cells, False, refined), b.detect_boxes(cells, True, refined)
    assert extents(plain, "side") == [(0, 34, 0, 4), (0, 34, 6, 9)]
    assert extents(plain, "stack") == [(0, 6, 0, 7), (8, 12, 0, 7), (14, 18, 0, 7)]
    assert extents(stitched, "stack") == [(0, 18, 0, 7)]
    assert extents(plain, "tiny") == []


def test_running_totals_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CHUNK", 3)
    df = spark.range(20).selectExpr("id % 2 as g", "id as i", "id * 2 as x")
    got = {(r.g, r.i): (r.s, r.p) for r in ranks.positions(
        ranks.running_totals(df, ["g"], "i", {"s": "x"}), ["g"], "i", "p").collect()}
    for g in (0, 1):
        members = [i for i in range(20) if i % 2 == g]
        for k, i in enumerate(members):
            assert got[(g, i)] == (sum(2 * j for j in members[:k + 1]), k + 1)
    last = {r.i: r.m for r in ranks.running_max(df.filter("g = 0"), ["g"], "i", "x", "m").collect()}
    assert last == {i: (None if i == 0 else 2 * (i - 2)) for i in range(0, 20, 2)}


N = None
SIMPLE = [["Plot ID", "Date", "Variety", "Treatment", "Moisture", "Yield t/ha", "Plant Height m", "Notes"],
          ["A7", "2025-07-11", "Ruby", "plain", 15.9, 11.25, 0.98, "by the ditch"],
          ["A8", "2025-07-12", "Ruby", "limed", 16.3, 10.75, 1.02, "weighed twice"],
          ["A9", "2025-07-14", "Onyx", "plain", 15.1, 31.5, 1.04, "too much to be true"],
          ["B1", "2025-07-15", "Onyx", "limed", 16.6, 11.5, 0.95, "dry"]]
NOISY = {"Log": [[N, N, "Season totals", N, N], ["Date", "Plot ID", "Yield", "Moisture", "Notes"], [N, N, "kg_ha", "pct", N],
                 ["2025-08-03", "B2", 13.3, 17.7, "fine"], ["2025-08-03", "B2", N, 18.2, "again, nothing weighed"],
                 ["2025-08-05", N, 14.6, N, "plot unreadable"], ["some day", "B4", N, 16.9, "day unreadable"]],
         "Remarks": [["nothing measured here"]]}
MULTI = {"Yield2026": [["Date", "Plot ID", "Variety", "Treatment", "Yield", "Notes"]] + [
    [f"2026-05-1{i}", f"Y{i}", "Apex" if i < 2 else "Nova", "control", 10.8 + i, "ok"] for i in range(4)],
    "Moisture2026": [["Date", "Plot ID", "Location", "Moisture"]] + [
    [f"2026-05-1{i}", f"M{i}", "north", 18.1 - i] for i in range(5)]}
UNDATED = [["Plot", "Yield kg/ha", "Height cm", "Site"]] + [[f"P{i}", 9000 + i, 100 + i, "north"] for i in range(8)]


@pytest.fixture(scope="module")
def ingested(spark, make_cells):
    cells, sheets = make_cells({"simple": SIMPLE, "noisy": NOISY, "multi": MULTI, "undated": UNDATED})
    shown = ingest.preview(cells, sheets)
    edited = ingest.edit(shown)
    return cells, sheets, edited, ingest.commit(edited).cache()


def test_workbooks_become_observations(ingested):
    _, _, _, observations = ingested
    by = {}
    for r in observations.collect():
        by.setdefault(r.upload_session_id, []).append(r)
    assert len(by["simple"]) == 12 and [r.validation_status for r in by["simple"]].count("warning") == 1
    assert len(by["noisy"]) == 8 and [r.validation_status for r in by["noisy"]].count("invalid") == 5
    assert sum("duplicate_candidate" in r.quality_flags for r in by["noisy"]) == 4
    assert {r.block_id for r in by["multi"]} == {"S1_B1", "S2_B1"} and len(by["multi"]) == 9
    yields = {r.plot_id: r.normalized_value for r in by["simple"] if r.variable == "yield"}
    assert yields["A7"] == 11250.0
    assert "undated" not in by


def test_violations_and_manifest(spark, ingested):
    cells, sheets, edited, _ = ingested
    assert {(r.artifact_id, r.violation) for r in ingest.violations(edited).collect()} == {("undated", "no_year")}
    manifest = sheet_manifest(sheets, cells, edited.blocks)
    warned = {(r.artifact_id, r.warning) for r in parse_warnings(manifest, ["artifact_id"]).collect()}
    assert warned == {("noisy", "no_blocks_detected:Remarks")}


def test_year_override_dates_a_block(spark, ingested):
    _, _, edited, _ = ingested
    override = spark.createDataFrame([("undated", 1, 2025)], "artifact_id string, seq int, year_override int")
    done = ingest.commit(ingest.edit(edited, year_overrides=override))
    rows = done.filter("upload_session_id = 'undated'").collect()
    assert len(rows) == 16 and {str(r.observation_date) for r in rows} == {"2025-01-01"}
