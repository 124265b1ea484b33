import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallgrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


CELLS = "artifact_id string, sheet_index int, row_idx long, col_idx int, kind string, text string"


@pytest.fixture(scope="session")
def make_cells(spark):
    """Cells and sheets of literal grids: {artifact: rows} or {artifact: {sheet name: rows}}."""
    def build(grids):
        rows, sheets = [], []
        for artifact, content in grids.items():
            content = content if isinstance(content, dict) else {artifact: content}
            for number, (name, grid) in enumerate(content.items(), start=1):
                sheets.append((artifact, number, name, artifact + ".xlsx", len(grid), max(map(len, grid), default=0)))
                rows += [(artifact, number, i, j, "num" if isinstance(x, (int, float)) else "str", str(x))
                         for i, row in enumerate(grid) for j, x in enumerate(row) if x is not None]
        return spark.createDataFrame(rows, CELLS), spark.createDataFrame(
            sheets, "artifact_id string, sheet_index int, sheet_name string, file_name string, row_count long, "
                    "max_column_count int")
    return build


SEED = [  # session, date, plot, variety, treatment, location, variable, value, unit, normalised, unit, status, flags
    ("u1", "2026-05-01", "P1", "Apex", "control", "north", "yield", 12.0, "t/ha", 12000.0, "kg/ha", "valid", []),
    ("u1", "2026-05-02", "P2", "Apex", "treated", "north", "yield", 15.0, "t/ha", 15000.0, "kg/ha", "warning",
     ["outlier_candidate"]),
    ("u1", "2026-05-03", "P3", "Nova", "control", "south", "yield", 9000.0, "kg/ha", 9000.0, "kg/ha", "invalid",
     ["missing_unit"]),
    ("u2", "2026-05-04", "P4", "Nova", "treated", "south", "yield", 11000.0, "kg/ha", 11000.0, "kg/ha", "valid", []),
    ("u3", "2026-05-01", "M1", None, None, "north", "moisture", 18.1, "%", 18.1, "%", "valid", []),
    ("u4", "2026-05-01", "H1", None, None, "north", "plant_height", 112.0, "cm", 112.0, "cm", "valid", []),
]


@pytest.fixture(scope="session")
def seed(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(SEED, "upload_session_id string, observation_date string, plot_id string, variety string, "
                                     "treatment string, location string, variable string, value double, unit string, "
                                     "normalized_value double, normalized_unit string, validation_status string, "
                                     "quality_flags array<string>")
    return df.withColumns({
        "observation_date": F.col("observation_date").cast("date"), "replicate": F.lit(None).cast("string"),
        "block_id": F.lit("S1_B1"), "source_sheet": F.lit("Sheet"),
        "source_row_index": F.substring("plot_id", 2, 1).cast("long") + 1, "source_column": F.col("variable")}).cache()
