"""Plans and counts that keep a step in proportion to its input."""

from pyspark.sql import functions as F

from tallgrid.operators import blocks as b
from tallgrid.operators import extract, harmonize, matching, quality
from tallgrid.sources import delimited, store
from tallgrid.plans import batch
from tallgrid.sources.cells import SHEET


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exploded(spark):
    """Cells exploded from rows of a few bytes: the planner takes them for as small as these rows."""
    return spark.range(3).select(
        F.col("id").cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("row_idx"), F.lit(0).cast("long").alias("col_idx"),
        F.lit("str").alias("kind"), F.lit("2020-05-05").alias("text"))


def test_cells_are_not_sent_to_every_task(spark):
    cells = _exploded(spark)
    boxes = spark.range(3).select(F.col("id").cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"), *[
        F.lit(n).cast("long").alias(e) for e, n in zip(b.EXTENT, (10, 19, 0, 0))])
    inside = b.cells_in(boxes, cells)
    assert "BroadcastHashJoin" not in _plan(inside)
    assert inside.groupBy(*SHEET).count().select("count").distinct().collect() == [(10,)]
    dates = b.context_dates(b.number_blocks(boxes), cells)
    assert "BroadcastHashJoin" not in _plan(dates)
    assert dates.count() == 3


def test_lines_and_words_of_boxes_are_not_sent_to_every_task(spark):
    cells = _exploded(spark).withColumn("col_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    boxes = spark.range(3).select(F.col("id").cast("string").alias("artifact_id"), F.lit(1).alias("sheet_index"), *[
        F.lit(n).cast("long").alias(e) for e, n in zip(b.EXTENT, (0, 99, 0, 9))])
    inside = b.cells_in(boxes, cells)
    for along, lines in (("col", 30), ("row", 294)):
        axis = b.axis_counts(boxes, inside, along)
        assert "BroadcastHashJoin" not in _plan(axis)
        assert axis.count() == lines and axis.filter("all_n <> 980 or first > idx or last < idx").count() == 0
    bands = boxes.select(*b.BOX, F.lit(4).cast("long").alias("start"), F.lit(5).cast("long").alias("stop"), F.lit(196).alias("cost"),
                         F.lit(False).alias("sparse"), F.lit(0.5).alias("norm"))
    found = b.label_bands(bands, inside)
    assert "BroadcastHashJoin" not in _plan(found)
    assert found.count() == 3


def test_boxes_that_share_a_column_merge_in_one_sweep(spark, monkeypatch):
    paired = []
    real = b._merge_pairs if hasattr(b, "_merge_pairs") else b.merge_overlaps
    monkeypatch.setattr(b, "_merge_pairs", lambda boxes: (paired.append(boxes.count()), real(boxes))[1], raising=False)
    monkeypatch.setattr(b.ranks, "CHUNK", 4)
    labelled = []
    label = b.components.label_components
    monkeypatch.setattr(b.components, "label_components", lambda *a: (labelled.append(a), label(*a))[1])
    schema = "artifact_id string, sheet_index int, r0 long, r1 long, c0 long, c1 long"
    chain = [("a", 1, r, r + 3, 0, r // 3 % 3) for r in range(0, 30, 3)] + [("a", 1, 40, 41, 2, 2), ("b", 1, 0, 90, 1, 5), ("b", 1, 7, 7, 5, 9)]
    got = lambda rows: sorted(tuple(x) for x in b.merge_overlaps(spark.createDataFrame(rows, schema)).select("artifact_id", *b.EXTENT).collect())
    merged = [("a", 0, 30, 0, 2), ("a", 40, 41, 2, 2), ("b", 0, 90, 1, 9)]
    assert got(chain) == merged and not paired and not labelled
    # side by side, and one that only the common box of two others meets
    mixed = [("c", 1, 0, 9, 0, 1), ("c", 1, 2, 5, 4, 5), ("d", 1, 0, 3, 0, 4), ("d", 1, 3, 9, 4, 4), ("d", 1, 8, 8, 0, 1), ("d", 1, 8, 9, 7, 7)]
    assert got(chain + mixed) == merged + [("c", 0, 9, 0, 1), ("c", 2, 5, 4, 5), ("d", 0, 9, 0, 4), ("d", 8, 9, 7, 7)]
    assert paired == [6] and got([]) == []


def test_block_cells_are_not_sent_to_every_task(spark):
    cells = _exploded(spark).select("artifact_id", F.lit("S1_B1").alias("block_id"), F.col("row_idx").alias("r"), F.lit(0).alias("col_pos"),
                                    (F.col("row_idx") + 1).alias("sheet_row"), "kind", "text")
    numbered = extract.number_rows(cells)
    assert "BroadcastHashJoin" not in _plan(numbered)
    assert numbered.filter("row_no <> sheet_row").count() == 0 and numbered.count() == 300


def test_only_small_files_are_read_whole(spark, tmp_path):
    import gzip
    import hashlib
    bodies = {"a.csv": b"x\n", "b.csv": b"line\n" * 50, "c.CSV.Gz": gzip.compress(bytes(range(256)) * 9), "d.txt": b"y" * 40}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    found = delimited.register_artifacts(spark, str(tmp_path), 30)
    assert {r.original_filename: r.file_hash_sha256 for r in found.collect()} == {
        n: hashlib.sha256(x).hexdigest() for n, x in bodies.items()}
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "content#" in line and "FileScan" in line]
    assert scans and all("LessThanOrEqual(length,30)" in x or "GreaterThan(length,30)" in x for x in scans)


def test_duplicate_keys_travel_as_hashes(spark, seed):
    twice = seed.unionByName(seed.filter("plot_id = 'M1'"))
    moved = twice.unionByName(seed.filter("plot_id = 'M1'").withColumns({  # the same fields with the NULLs elsewhere
        "variety": F.col("location"), "location": F.lit(None).cast("string")}))
    flagged = quality.flag_duplicates(moved)
    assert flagged.filter("is_duplicate").select("plot_id", "location").collect() == [("M1", "north")] * 2
    assert flagged.columns == [*moved.columns, "is_duplicate"] and flagged.count() == seed.count() + 2
    assert "struct" not in _plan(flagged) and "_key1" in _plan(flagged)


def test_rows_carry_no_hashes_and_are_judged_after_they_moved(spark, seed, tmp_path):
    rows = seed.drop("normalized_value", "normalized_unit", "validation_status", "quality_flags")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(xxhash64(" in _plan(quality.flag_duplicates(rows))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before, seen = spark.conf.get(dealt, None), []

    def finish(moved):
        seen.append(int(spark.conf.get(dealt)))
        return quality.judge(quality.normalise_observation(moved))
    store.rebuild_partition(quality.flag_duplicates(rows), str(tmp_path / "obs"), finish=finish)
    assert seen == [200] and spark.conf.get(dealt, None) == before
    expected = quality.validate(quality.normalise_observation(rows))
    written = spark.read.parquet(str(tmp_path / "obs")).select(*expected.columns)
    assert sorted(map(str, written.collect())) == sorted(map(str, expected.collect()))


def test_a_few_columns_are_looked_up_without_a_shuffle_of_the_cells(spark):
    # the planner takes this table of two rows for 10^7 rows
    few = spark.range(10**7).select((F.col("id") % 2).cast("int").alias("col_pos")).distinct()
    columns = few.select(F.lit("a").alias("artifact_id"), F.lit("S1_B1").alias("block_id"), "col_pos", F.lit("yield").alias("column"),
                         F.lit("measure").alias("semantic_role"), F.lit(None).cast("string").alias("canonical_dimension"))
    values = spark.range(40).select(F.lit("a").alias("artifact_id"), F.lit("S1_B1").alias("block_id"), (F.col("id") % 2).cast("int").alias(
        "col_pos"), F.floor(F.col("id") / 2).alias("row_no"), F.col("id").alias("sheet_row"), F.lit("num").alias("kind"),
        F.col("id").cast("string").alias("text"))
    facts = harmonize.row_facts(values, columns)
    assert facts.count() == 20
    assert "BroadcastHashJoin" in _plan(facts)


def test_lists_rank_only_rows_up_to_the_month_that_fills_them(spark, seed):
    obs = seed.filter("plot_id in ('P1', 'P4')").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(899)))).withColumns({
        "observation_date": F.when(F.col("_i") % 9 > 0, F.date_add("observation_date", F.col("_i"))), "source_row_index": F.col("_i") + 1}
    ).drop("_i")
    keys = spark.createDataFrame([(0, "Apex"), (0, "Nova"), (0, "none")], "combination int, key string")
    bars = batch._leading_months(keys, obs, [("f_variety",)])
    # eight of nine rows have a date: 225 days hold 200 of them, from 1 and from 4 May 2026
    assert {r.key: r.bar for r in bars.collect()} == {"Apex": 2026 * 12 + 12, "Nova": 2026 * 12 + 12, "none": batch.UNDATED}
    assert bars.filter("key = 'none'").count() == 1
    plan = spark.createDataFrame([(1, "Apex", 200, ["valid"])], "question_id int, f_variety string, row_limit int, statuses array<string>").select(
        "*", F.lit("supported").alias("status"), F.lit("select").alias("intent"), F.lit(False).alias("dedupe"),
        *[F.lit(None).cast("date" if f == "f_day" else "int" if f == "f_year" else "string").alias(f)
          for f in batch.FILTERS if f not in ("f_variety", "f_status")])
    listed = batch.execute_lists(plan, obs)
    assert "bar" in listed._jdf.queryExecution().optimizedPlan().toString()
    got = [r.source_row_index for r in listed.orderBy("rank").collect()]
    assert got == [i + 1 for i in range(900) if i % 9][:200]


def test_windows_of_texts_are_not_sent_to_every_task(spark):
    texts = spark.createDataFrame([("show north and south",)], "text string")
    few = spark.range(10**7).select(F.element_at(F.array(F.lit("north"), F.lit("west")), (F.col("id") % 2 + 1).cast("int")).alias("value")).distinct()
    found = matching.contained(texts, "text", few, "value")
    assert [r.value for r in found.collect()] == ["north"]
    assert "BuildRight" in _plan(found) and "BuildLeft" not in _plan(found)


def test_scores_are_added_up_where_the_texts_are(spark):
    from tallgrid.operators import retrieval as r
    docs = spark.createDataFrame([("a", 0, 0, "t", "red barn", "wheat in rows", {"k": "v1"}, None), ("a", 1, 0, "t", "", "late wheat", {}, None),
                                  ("b", 0, 1, "t", "blue", "wheatfield", {}, None), ("c", 0, 2, "t", "x", None, {}, None)], r.DOC_SCHEMA)
    asked = spark.createDataFrame([(1, "late wheat"), (2, "wheat"), (3, "red rows"), (4, "nothing")], "query_id int, query string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = r.score(asked, docs)
        plan = _plan(scores)
        got = {(x.query_id, x.document_id): x.score for x in scores.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, "a"): 29.0, (1, "b"): 2.0, (2, "a"): 27.0, (2, "b"): 27.0, (3, "a"): 7.0}
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert not [line for line in moved if "hashpartitioning(word" in line or "hashpartitioning(document_id#" in line and "token#" in line.split("]")[0]], moved
    assert not [line for line in moved if "hashpartitioning(token" in line], moved


def test_lists_meet_by_question_once(spark, seed):
    asked = spark.createDataFrame([(i, "supported", "select", 2, i == 2, ["valid", "warning"]) for i in (1, 2)],
                                  "question_id long, status string, intent string, row_limit int, dedupe boolean, statuses array<string>")
    made = asked.select("*", *[F.lit(None).cast("string").alias(f) for f in batch.FILTERS if f not in ("f_status", "f_day", "f_year")],
                        F.lit(None).cast("date").alias("f_day"), F.lit(None).cast("int").alias("f_year"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        listed = batch.execute_lists(made, seed)
        plan = _plan(listed)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(question_id" in line]
    assert len(moved) == 1 and "REPARTITION_BY_COL" in moved[0], moved
    places = {q: [r["rank"] for r in listed.filter(F.col("question_id") == q).orderBy("rank").collect()] for q in (1, 2)}
    assert places == {1: [1, 2], 2: [1, 2]}


def test_known_values_take_no_commit_and_equal_the_committed_ones(spark, monkeypatch):
    from tallgrid.registry import asking
    sf = "/root/testdata/sf0.001"
    committed = sorted(map(tuple, asking.known_values(spark, sf).collect()))

    def refuse(*_):
        raise AssertionError("observations were committed")
    monkeypatch.setattr(asking, "observations", refuse)
    for tags in (asking.tags_a, asking.tags_b):
        assert tags(spark, sf).count() == asking.asked(spark, sf).count()
    assert sorted(map(tuple, asking.stated_values(spark, sf).collect())) == committed
