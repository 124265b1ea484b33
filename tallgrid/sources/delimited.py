"""Delimited text files as cells.

Lines come from the splittable text reader, so a very large file is read by many tasks; charset, delimiter and
record boundaries are decided per file from aggregates and prefix scans over its lines.
"""

from __future__ import annotations

import codecs
import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.operators import ranks
from tallgrid.session import cut

SEPARATORS = (",", ";", "\t", "|")  # fixed value: candidates in order of preference
UNDEFINED_1250 = r"[\x{81}\x{83}\x{88}\x{90}\x{98}]"  # bytes without a meaning in cp1250
WHOLE_FILE = 64 << 20
COMPRESSED = ("gz", "bz2", "deflate", "snappy", "lz4", "zst")  # suffixes that the text reader unpacks
PACKED_NAMES = "*.{" + ",".join("".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in s) for s in COMPRESSED) + "}"
MIME_TYPES = {"csv": "text/csv", "tsv": "text/tab-separated-values", "xls": "application/vnd.ms-excel",
              "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}


def _named(path: Column) -> tuple[Column, Column]:
    """Name and lower-case suffix of a file."""
    name = F.element_at(F.split(path, "/"), -1)
    return name, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def streamed_digests(spark: SparkSession, path: str, above: int) -> DataFrame:
    """(path, digest): SHA-256 of the files of more than ``above`` bytes, read in splits and never held whole.

    Splits hand on their lines; the task of a file takes them in order through one running digest, a batch at a time. The text
    reader drops line ends and a leading byte order mark: the file's size tells which of these to put back.
    """
    c = F.col
    lines = spark.read.option("lineSep", "\n").text(path).select(
        c("_metadata.file_path").alias("path"), c("_metadata.file_size").alias("size"),
        c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        c("value").cast("binary").alias("line")).filter(c("size") > above)
    # bytes not accounted for by lines and one line end each: -1 without a last line end, 3 more with a mark
    missing = c("size") - F.sum(F.octet_length("line") + 1)
    facts = lines.groupBy("path", "size").agg(missing.alias("missing")).select(
        c("path"), (c("missing") >= 2).alias("mark"), c("missing").isin(0, 3).alias("ended"))

    def digest(batches):
        current, running, ended = None, None, False
        for batch in batches:
            paths, marks, ends, bodies = (batch.column(n) for n in ("path", "mark", "ended", "line"))
            for i in range(len(paths)):
                name = paths[i].as_py()
                if name != current:
                    if running is not None:
                        running.update(b"\n" if ended else b"")
                        yield pa.RecordBatch.from_pydict({"path": [current], "digest": [running.hexdigest()]})
                    current, running, ended = name, hashlib.sha256(codecs.BOM_UTF8 if marks[i].as_py() else b""), ends[i].as_py()
                else:
                    running.update(b"\n")
                running.update(memoryview(bodies[i].as_buffer()))
        if running is not None:
            running.update(b"\n" if ended else b"")
            yield pa.RecordBatch.from_pydict({"path": [current], "digest": [running.hexdigest()]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.join(facts, "path").repartition(tasks, "path").sortWithinPartitions("path", "block", "at")
    return ordered.select("path", "mark", "ended", "line").mapInArrow(digest, "path string, digest string")


def register_artifacts(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """Name, type, size, SHA-256 and provenance of every file under ``path``.

    Files of up to ``whole`` bytes are read as one value, larger ones in splits. Compressed files are always read as one value
    (splits would hand on what they hold, not their bytes), so these are limited to 2 GB. Empty files are not listed.
    """
    c = F.col
    files = spark.read.format("binaryFile").load(path)
    name, suffix = _named(c("path"))
    # the reader skips the bytes of the other files only for a plain test of their length, so packed files are named apart
    packed = spark.read.format("binaryFile").option("pathGlobFilter", PACKED_NAMES).load(path).filter(c("length") > whole)
    small = files.filter(c("length") <= whole).select("_metadata", "content").unionByName(packed.select("_metadata", "content")).select(
        c("_metadata.file_path").alias("_file"), F.sha2("content", 256).alias("digest"))
    streamed = streamed_digests(spark, path, whole).select(c("path").alias("_file"), "digest")
    large = streamed.filter(~_named(c("_file"))[1].isin(*COMPRESSED))
    mime = F.coalesce(*[F.when(suffix == s, F.lit(m)) for s, m in MIME_TYPES.items()],
                      F.lit("application/octet-stream"))
    listed = files.select("path", "length", "modificationTime", c("_metadata.file_path").alias("_file"))
    return listed.join(small.unionByName(large), "_file").select(
        c("path").alias("artifact_id"), F.url_decode(name).alias("original_filename"), mime.alias("mime_type"),
        c("length").alias("file_size_bytes"), c("digest").alias("file_hash_sha256"),
        F.lit(catalog.PARSER_VERSION).alias("parser_version"), c("modificationTime").alias("uploaded_at"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(artifact_id, file_name, line_no, raw): undecoded lines numbered from 0 per file.

    A split knows its offset and keeps its lines in order; numbering counts lines per split and adds the splits
    before it, so no task sees more than one split.
    """
    scanned = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("artifact_id"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("raw"))
    sizes = scanned.groupBy("artifact_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("artifact_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("artifact_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("artifact_id", "block").orderBy("at"))
    return (scanned.withColumn("k", inside).join(starts, ["artifact_id", "block"])
            .select("artifact_id", "file_name", (F.col("first") + F.col("k") - 1).alias("line_no"), "raw"))


def _single_byte(raw: Column, charset: str) -> Column:
    """Bytes as text of a one-byte charset, by a table over the upper half of Latin-1."""
    upper = [bytes([b]) for b in range(0x80, 0x100)]
    pairs = [(b.decode("latin-1"), b.decode(charset, errors="replace")) for b in upper]
    latin = F.decode(raw.cast("binary"), "ISO-8859-1")
    return F.translate(latin, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def decode_text(lines: DataFrame) -> DataFrame:
    """Adds ``text``, decoded with the first charset that fits the whole file."""
    latin = F.decode(F.col("raw").cast("binary"), "ISO-8859-1")
    facts = lines.groupBy("artifact_id").agg(
        F.bool_and(F.is_valid_utf8("raw")).alias("utf8"),
        F.bool_or(latin.rlike(UNDEFINED_1250)).alias("no_1250"))
    bom = "﻿"
    unicode = F.when((F.col("line_no") == 0) & F.col("raw").startswith(bom), F.substring("raw", 2, 2**31 - 1)) \
        .otherwise(F.col("raw"))
    text = (F.when(F.col("utf8"), unicode).when(F.col("no_1250"), _single_byte(F.col("raw"), "iso-8859-2"))
            .otherwise(_single_byte(F.col("raw"), "cp1250")))
    return lines.join(facts, "artifact_id").withColumn("text", text).drop("raw", "utf8", "no_1250")


def detect_delimiter(lines: DataFrame) -> DataFrame:
    """S3: (artifact_id, sep). Tab for .tsv; else the candidate whose count per line is most constant over all lines
    (quoted parts left out); comma when nothing fits."""
    c = F.col
    sample = lines.filter(F.trim("text") != "")
    bare = F.regexp_replace("text", '"[^"]*"', "")
    counts = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("sep"),
                                (F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))).alias("hits"))
                       for i, s in enumerate(SEPARATORS)])
    per_line = sample.select("artifact_id", F.explode(counts).alias("c")).select("artifact_id", "c.*")
    same = per_line.groupBy("artifact_id", "ord", "sep", "hits").agg(F.count(F.lit(1)).alias("n"))
    best = same.filter(c("hits") > 0).groupBy("artifact_id").agg(
        F.max_by("sep", F.struct(c("n"), c("hits"), -c("ord"))).alias("found"))
    files = lines.select("artifact_id", "file_name").distinct()
    sep = F.when(F.lower("file_name").endswith(".tsv"), "\t").otherwise(F.coalesce("found", F.lit(",")))
    return files.join(best, "artifact_id", "left").select("artifact_id", "file_name", sep.alias("sep"))


def _per_separator(build) -> Column:
    """An expression whose pattern depends on the row's separator."""
    return F.coalesce(*[F.when(F.col("sep") == s, build("\\t" if s == "\t" else "\\" + s)) for s in SEPARATORS])


def stitch_records(lines: DataFrame) -> DataFrame:
    """(artifact_id, sep, record_no, record): lines joined over quoted line breaks; blank lines stay records.

    A line maps "inside quotes before" to "inside quotes after": it sets the state, keeps it or flips it. The state
    before a line is the value of the last setting line, flipped as often as lines flipped since.
    """
    c = F.col
    field = lambda s: rf'(?:"(?:[^"]|"")*+"[^{s}]*+|[^{s}"][^{s}]*+|)'
    opened = lambda s: rf'(?:{field(s)}{s})*+"(?:[^"]|"")*+$'
    from_out = _per_separator(lambda s: c("text").rlike(rf"(?s)^{opened(s)}"))
    from_in = _per_separator(lambda s: c("text").rlike(rf'(?s)^(?:[^"]|"")*+(?:$|"[^{s}]*+{s}{opened(s)})'))
    # the scans run on numbers only; the texts join once their record is known
    moved = cut(lines.select("artifact_id", "line_no", from_out.cast("int").alias("from_out"),
                             from_in.cast("int").alias("from_in"))
                .withColumn("flip", ((c("from_out") == 1) & (c("from_in") == 0)).cast("long")))
    counted = cut(ranks.running_totals(moved, ["artifact_id"], "line_no", {"flips": "flip"}))
    setting = F.when(c("from_out") == c("from_in"), F.struct("line_no", c("from_out").alias("state"), "flips"))
    last = ranks.running_max(counted.withColumn("setting", setting), ["artifact_id"], "line_no", "setting", "last")
    state = (F.coalesce("last.state", F.lit(0)) + c("flips") - c("flip") - F.coalesce("last.flips", F.lit(0))) % 2
    begun = cut(last.select("artifact_id", "line_no", (state == 0).cast("long").alias("begins")))
    numbers = ranks.running_totals(begun, ["artifact_id"], "line_no", {"record_no": "begins"})
    numbered = lines.join(numbers.select("artifact_id", "line_no", "record_no"), ["artifact_id", "line_no"])
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))  # the lines of one record
    return numbered.groupBy("artifact_id", "sep", "record_no").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("record"))


def split_fields(record: Column) -> Column:
    """Fields of a record as text; quotes removed, doubled quotes single."""
    raw = _per_separator(lambda s: F.regexp_extract_all(
        F.concat(F.col("sep"), record), F.lit(rf'{s}("(?:[^"]|"")*+(?:"[^{s}]*+|$)|[^{s}]*+)'), F.lit(1)))
    body = lambda f: F.replace(F.regexp_extract(f, r'(?s)^"((?:[^"]|"")*+)"?(.*)$', 1), F.lit('""'), F.lit('"'))
    rest = lambda f: F.regexp_extract(f, r'(?s)^"((?:[^"]|"")*+)"?(.*)$', 2)
    return F.transform(raw, lambda f: F.when(f.startswith('"'), F.concat(body(f), rest(f))).otherwise(f))


def read_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, sheets) of all delimited files under ``path``; one sheet per file, named after it."""
    return lines_to_cells(decode_text(read_lines(spark, path)))


def lines_to_cells(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3, S4 on (artifact_id, file_name, line_no, text)."""
    separators = detect_delimiter(lines)
    records = stitch_records(lines.drop("file_name").join(separators.drop("file_name"), "artifact_id"))
    fields = records.select("artifact_id", (F.col("record_no") - 1).alias("row_idx"), F.when(
        F.col("record") == "", F.array().cast("array<string>")).otherwise(split_fields(F.col("record"))).alias("fields"))
    cells = fields.select("artifact_id", F.lit(1).alias("sheet_index"), "row_idx",
                          F.posexplode("fields").alias("col_idx", "text")).filter(F.col("text") != "").select(
        "artifact_id", "sheet_index", "row_idx", "col_idx", F.lit("str").alias("kind"), "text")
    extents = fields.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("row_count"),
                                                F.max(F.size("fields")).alias("max_column_count"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    sheets = separators.join(extents, "artifact_id").select(
        "artifact_id", F.lit(1).alias("sheet_index"), stem.alias("sheet_name"), "file_name", "row_count",
        "max_column_count")
    return cells, sheets


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
