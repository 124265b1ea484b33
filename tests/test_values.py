import math
import random
import string
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallgrid.functions import text as x
from tallgrid.functions import units
from tallgrid.functions import values as v


def rows(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.out for r in df.select("i", expression(F.col("t")).alias("out")).orderBy("i").collect()]


def python_number(text):
    try:
        return float(text.strip())
    except ValueError:
        return None


def python_date(text):
    text = text.strip()
    try:
        return datetime.fromisoformat(text).date()
    except ValueError:
        pass
    for fmt in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y"):
        try:
            return datetime.strptime(text, fmt).date()
        except ValueError:
            continue
    return None


def test_numbers_follow_the_python_grammar(spark):
    generator = random.Random(3)
    texts = ["1e3", "1_000", "1__0", "_1", "nan", "-inf", "+Infinity", "1d", "0x10", ".5", "5.", ".", "1e", "", "  7 ",
             "1,5", "--1", "1.5e-3", "\t8\n", "\xa09", "1_0.2_5e1_0"]
    texts += ["".join(generator.choice("0123456789._eE+-") for _ in range(generator.randint(1, 6))) for _ in range(400)]
    numbers = rows(spark, texts, v.to_numeric)
    flags = rows(spark, texts, v.is_numeric)
    for text, number, flag in zip(texts, numbers, flags):
        expected = python_number(text)
        assert flag == (expected is not None), text
        assert (number is None) == (expected is None), text
        if expected is not None:
            assert number == expected or (math.isnan(number) and math.isnan(expected)), text


def test_dates_follow_the_format_list(spark):
    generator = random.Random(4)
    texts = ["3/4/2024", "13/4/2024", "4/13/2024", "2024-7-1", "2024/7/1", "20240701", "2024-07-01 10:20:30",
             "2024-07-01T10", "2024-07-01 junk", "2024", "31-12-1999", "12-31-1999", "30/02/2024", "2024-W27-1", "2024W271",
             "2024-W53", "0000-01-01", "2024-07-01T10:20:30+02:00", " 2024-07-01 ", "1-2-3", "2024-02-30"]
    texts += [f"{generator.randint(0, 40)}{s}{generator.randint(0, 14)}{s}{generator.choice([1999, 2024, 99])}"
              for s in "-/" for _ in range(150)]
    for text, day in zip(texts, rows(spark, texts, v.parse_date)):
        assert day == python_date(text), text


def test_dotted_dates_years_and_ranges(spark):
    assert [str(d) for d in rows(spark, ["2017. 07. 5-6.", "sown 2017.7.5", "2017. 13. 1."], v.dotted_date)] == [
        "2017-07-05", "2017-07-05", "None"]
    assert rows(spark, ["trial 2017 a", "x2017", "1899", "12017"], v.year_in) == [2017, None, None, None]
    label = spark.range(1).select(v.range_label(*[F.lit(n) for n in (1, 9, 1, 703)]).alias("l")).first().l
    assert label == "A1:AAA9"


def test_headers(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (2, 0, "a")], "b int, p int, h string")
    unique = v.make_unique_headers(df, ["b"], "h", "p").orderBy("b", "p").collect()
    assert [r.h for r in unique] == ["a", "b", "a_2", "a_3", "a"]


@pytest.mark.parametrize("column,meaning,treatment,code,replicate", [
    ("n_40_b", "yield", "n_40", "b", None), ("ii._suly", None, None, None, "II."), ("plain", None, None, None, None)])
def test_measure_column_meta(spark, column, meaning, treatment, code, replicate):
    found = spark.range(1).select(*[e.alias(n) for n, e in v.measure_column_meta(
        F.lit(column), F.lit(None).cast("string")).items()]).first()
    assert (found.meaning, found.treatment, found.replicate_column_code, found.replicate) == (
        meaning, treatment, code, replicate)


def test_units(spark):
    cases = [("yield", 12.5, "t/ha", 12500.0), ("yield", 3.0, "kg/parc", None), ("moisture", 18.0, "%", 18.0),
             ("plant_height", 1.12, "m", 112.0), ("plant_height", 5.0, "%", None), ("weight", 1.0, "cm", None)]
    df = spark.createDataFrame(cases, "m string, x double, u string, expected double")
    for r in df.select("*", units.normalize_value(F.col("m"), F.col("x"), F.col("u")).alias("got")).collect():
        assert r.got == r.expected


def fold_python(text, keep):
    parts = unicodedata.normalize("NFKD", text.casefold())
    plain = "".join(c for c in parts if not unicodedata.combining(c))
    return " ".join("".join(c if c in keep else " " for c in plain).split())


def test_folding_matches_unicode_decomposition(spark):
    samples = ["Őszi BÚZA, Mv Toborzó", "Straße ﬁn ½ ² Ａbc", "été-naïve ÇA", "Íslenzka Þorn", "x_y.z/50%", "Ǆ ŉ ſ", "ÀÉÎÕÜ ñ ß"]
    every = [chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x30000))]
    samples += [" ".join(f"a{ch}b" for ch in every[i:i + 256]) for i in range(0, len(every), 256)]
    keep = set(string.ascii_lowercase + string.digits + "%/._-")
    for text, folded in zip(samples, rows(spark, samples, x.fold_document)):
        assert folded == fold_python(text, keep), (text, hex(ord(text[0])))


def test_fold_ascii(spark):
    samples = ["Súly  termés?", "Straße ½", "ﬁn – Ω", "㎏ ① ㏂ Ⅻ 𝐀𝟗 ⑴"]
    every = [chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000))]
    samples += [" ".join(f"a{ch}b" for ch in every[i:i + 256]) for i in range(0, len(every), 256)]
    for text, folded in zip(samples, rows(spark, samples, x.fold_ascii)):
        plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
        assert folded == " ".join(plain.split())


def test_snippet_cuts_around_the_first_hit(spark):
    text = "word " * 30 + "needle " + "tail " * 60
    shown = spark.createDataFrame([(text,)], "t string").select(
        x.snippet(F.col("t"), F.array(F.lit("needle"), F.lit("zzz"))).alias("s")).first().s
    assert shown.startswith("...") and shown.endswith("...") and "needle" in shown and len(shown) <= 226


def test_distinct_words_are_exact_around_the_threshold(spark):
    from tallgrid.operators import profile
    rows = [("a", "b", col, n, "str", f"Word {n % d}" if n % 3 else f"word {n % d} ") for col, d in enumerate((1, 31, 32, 33, 200))
            for n in range(600)]
    df = spark.createDataFrame(rows, "artifact_id string, block_id string, col_pos int, row_no int, kind string, text string").repartition(7)
    got = {r.col_pos: r.n_distinct for r in profile.column_aggregates(df).collect()}
    assert got == {0: 1, 1: 31, 2: 32, 3: 33, 4: 200}
