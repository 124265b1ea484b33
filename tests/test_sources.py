import codecs
import csv
import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from tallgrid.sources import cells as cl
from tallgrid.sources import delimited, store

FILES = {
    "comma.csv": b"x,y\n1,2\n\n3\n", "semicolon.csv": b'x;y;z\n1;2,5;3\n\n4;;"q;1"\n', "tab.tsv": b"a\tb\n1\t2,3\n",
    "latin.csv": "név;érték\nőszi;1\n".encode("cp1250"), "mark.csv": b"\xef\xbb\xbfh1,h2\n1,2\n",
    "quoted.csv": b'h1,h2\n"multi\nline ""q""",2\n5" pipe,3\n"a"b,"x,y"\n"open\n\n\nfour lines",9\n',
    "undefined.csv": b"a;b\n\x81\xe1;2\n", "long.csv": b"".join(b'%d,"say ""%d""\nagain, twice",end\n' % (i, i) for i in range(300)),
}
EXPECTED = {"comma.csv": ("utf-8", ","), "semicolon.csv": ("utf-8", ";"), "tab.tsv": ("utf-8", "\t"),
            "latin.csv": ("cp1250", ";"), "mark.csv": ("utf-8-sig", ","), "quoted.csv": ("utf-8", ","),
            "undefined.csv": ("iso-8859-2", ";"), "long.csv": ("utf-8", ",")}


def read_all(spark, folder):
    cells, sheets = delimited.read_delimited(spark, str(folder))
    named = cells.join(sheets.select("artifact_id", "file_name"), "artifact_id")
    found = {name: {} for name in FILES}
    for r in named.collect():
        found[r.file_name][(r.row_idx, r.col_idx)] = r.text
    return found, {r.file_name: (r.row_count, r.max_column_count) for r in sheets.collect()}


def check(spark, folder):
    found, extents = read_all(spark, folder)
    for name, data in FILES.items():
        charset, sep = EXPECTED[name]
        rows = list(csv.reader(io.StringIO(data.decode(charset), newline=""), delimiter=sep))
        cells = {(i, j): t for i, row in enumerate(rows) for j, t in enumerate(row) if t != ""}
        assert found[name] == cells, name
        assert extents[name] == (len(rows), max(map(len, rows))), name


def test_delimited_files_equal_the_csv_module(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    check(spark, tmp_path)


def test_lines_keep_their_order_over_many_splits(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        check(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_artifacts(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes(b"x,y\n")
    row = delimited.register_artifacts(spark, str(tmp_path)).first()
    assert (row.original_filename, row.mime_type, row.file_size_bytes) == ("a b.csv", "text/csv", 4)
    assert len(row.file_hash_sha256) == 64


def test_merged_ranges_are_clipped_and_the_last_wins(spark, make_cells):
    cells, sheets = make_cells({"m": [["a", "b", "c"], ["d", "e", "f"]]})
    ranges = spark.createDataFrame([("m", 1, 0, 0, 1, 0, 2), ("m", 1, 1, 1, 9, 1, 9), ("m", 1, 2, 5, 6, 0, 2)],
                                   "artifact_id string, sheet_index int, ord int, row_start long, row_end long, col_start int, "
                                   "col_end int")
    got = {(r.row_idx, r.col_idx): r.text for r in cl.expand_merged(cells, sheets, ranges).collect()}
    assert got == {(0, 0): "a", (0, 1): "a", (0, 2): "c", (1, 0): "d", (1, 1): "e", (1, 2): "e"}


def test_recommit_replaces_only_its_uploads(spark, seed, tmp_path):
    path = str(tmp_path / "observations")
    store.rebuild_partition(seed, path)
    store.rebuild_partition(seed.filter("upload_session_id = 'u1'").withColumn("value", F.lit(1.0)), path)
    store.rebuild_partition(seed.filter("upload_session_id = 'u1'").withColumn("value", F.lit(1.0)), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 6
    assert {r.value for r in stored.filter("upload_session_id = 'u1'").collect()} == {1.0}
    assert {r.value for r in stored.filter("upload_session_id = 'u2'").collect()} == {11000.0}
    store.rebuild_partition(seed.filter("upload_session_id = 'u1'"), path, ["u1", "u2"])
    assert {r[0] for r in spark.read.parquet(path).select("upload_session_id").distinct().collect()} == {"u1", "u3", "u4"}


def test_audit_and_status(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, correlation_id string")
    assert [r.id for r in store.tail_audit(log, "a").collect()] == [3, 1]
    events = spark.createDataFrame([("s", 1, "preview_ready", None), ("s", 2, "failed", "boom")],
                                   "session_id string, seq int, status string, commit_error string")
    assert store.current_status(events).first().commit_error == "boom"


def test_digests_of_files_read_whole_and_in_splits(spark, tmp_path):
    """Any bytes: marks, line ends of all kinds, none at the end, no text at all, an empty file, a packed file."""
    g = random.Random(31)
    noise = bytes(g.randrange(256) for _ in range(60_000))
    bodies = {"plain.csv": b"a,b\n1,2\n", "open.csv": b"a,b\n1,2", "mark.csv": codecs.BOM_UTF8 + b"a\nb\n", "mark open.tsv": codecs.BOM_UTF8 + b"a\nb",
              "windows.csv": b"a\r\nb\r\n\r\n", "noise.bin": noise, "lines.txt": noise.replace(b"a", b"\n") + b"\n", "empty.csv": b"", "blank.csv": b"\n",
              "long.csv": b"x" * 200_000, "packed.gz": gzip.compress(noise), "two marks.csv": codecs.BOM_UTF8 * 2 + b"\n" * 5}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    want = {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items() if body}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for whole in (0, 1000, delimited.WHOLE_FILE):
            got = delimited.register_artifacts(spark, str(tmp_path), whole).collect()
            assert {r.original_filename: (r.file_size_bytes, r.file_hash_sha256) for r in got} == want
            assert {r.original_filename: r.mime_type for r in got}["open.csv"] == "text/csv"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
