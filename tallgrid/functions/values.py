"""Column expressions on untyped cell text: missing, numbers, dates, names, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
DIGITS = r"\d+(?:_\d+)*"
NUMBER = rf"^[+-]?(?:{DIGITS}(?:\.(?:{DIGITS})?)?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?$"
ANY_NUMBER = rf"(?i)^[+-]?(?:(?:{DIGITS}(?:\.(?:{DIGITS})?)?|\.{DIGITS})(?:e[+-]?{DIGITS})?|inf|infinity|nan)$"
INFINITE = r"(?i)^[+-]?(?:inf|infinity)$"
NOT_A_NUMBER = r"(?i)^[+-]?nan$"
CLOCK = r"(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
YEAR_WORD = r"(?<![\p{L}\p{N}_])((?:19|20)\d{2})(?![\p{L}\p{N}_])"
DOTTED = r"(?<![\p{L}\p{N}_])((?:19|20)\d{2})\.\s*(\d{1,2})\.\s*(\d{1,2})(?![\p{L}\p{N}_])"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_missing(c: Column) -> Column:
    """F1."""
    return c.isNull() | (strip(c) == "")


def normalize_header(header: Column, position: Column) -> Column:
    """F2; ``position`` is 0-based."""
    cleaned = F.replace(F.lower(strip(header)), F.lit(" "), F.lit("_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.concat(F.lit("column_"), (position + 1).cast("string")))


def is_numeric(c: Column) -> Column:
    """F6 for text; typed booleans must be screened by the caller."""
    return F.coalesce(strip(c).rlike(ANY_NUMBER), F.lit(False))


def to_numeric(c: Column) -> Column:
    """F7."""
    s = strip(c)
    return (
        F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
        .when(s.rlike(INFINITE), F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .when(s.rlike(NOT_A_NUMBER), F.lit(float("nan")))
    )


def is_textual(c: Column) -> Column:
    """F8."""
    return ~is_missing(c) & ~is_numeric(c)


def _calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date from digit strings, NULL when the calendar has no such day."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when((year != "") & (year != "0000"), text.try_cast("date"))


def _by_pattern(s: Column, pattern: str, year: int, month: int, day: int) -> Column:
    part = lambda i: F.regexp_extract(s, pattern, i)
    return F.when(s.rlike(pattern), _calendar_date(part(year), part(month), part(day)))


def _iso_week_date(s: Column) -> Column:
    pattern = rf"^(\d{{4}})(-?)W(\d{{2}})(?:\2([1-7]))?(?:.{CLOCK})?$"
    year = F.regexp_extract(s, pattern, 1)
    week = F.regexp_extract(s, pattern, 3).try_cast("int")
    day = F.coalesce(F.nullif(F.regexp_extract(s, pattern, 4), F.lit("")).try_cast("int"), F.lit(1))
    fourth = F.concat(year, F.lit("-01-04")).try_cast("date")
    monday = F.date_sub(fourth, F.weekday(fourth))
    found = F.date_add(monday, (week - 1) * 7)
    real = (week >= 1) & (F.weekofyear(found) == week)
    return F.when(s.rlike(pattern), F.when(real, F.date_add(found, day - 1)))


def parse_date(c: Column) -> Column:
    """ISO first, then six patterns; the first hit wins, so 3/4/2024 is 3 April."""
    s = strip(c)
    likely = s.rlike(r"^\d{1,4}[-/\dW]")  # most cells are no dates and stop here
    return F.when(likely, F.coalesce(
        _by_pattern(s, rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:.{CLOCK})?$", 1, 2, 3),
        _by_pattern(s, rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:.{CLOCK})?$", 1, 2, 3),
        _iso_week_date(s),
        _by_pattern(s, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3),
        _by_pattern(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3),
        _by_pattern(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1),
        _by_pattern(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2),
        _by_pattern(s, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 2, 1),
        _by_pattern(s, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 1, 2),
    ))


def year_in(c: Column) -> Column:
    """F11."""
    return F.nullif(F.regexp_extract(c, YEAR_WORD, 1), F.lit("")).try_cast("int")


def dotted_date(c: Column) -> Column:
    """F12."""
    return _by_pattern_anywhere(strip(c))


def _by_pattern_anywhere(s: Column) -> Column:
    part = lambda i: F.regexp_extract(s, DOTTED, i)
    return F.when(s.rlike(DOTTED), _calendar_date(part(1), part(2), part(3)))


def context_date(c: Column) -> Column:
    """A full cell date, else a dotted date anywhere in the text."""
    return F.coalesce(parse_date(c), dotted_date(c))


def serialize_cell(kind: Column, text: Column, number: Column, day: Column, flag: Column) -> Column:
    """one text form for a tagged cell."""
    return (
        F.when(kind == "date", F.date_format(day, "yyyy-MM-dd"))
        .when(kind == "num", number.cast("string"))
        .when(kind == "bool", F.initcap(flag.cast("string")))
        .otherwise(text)
    )


def column_letters(position: Column) -> Column:
    """Spreadsheet letters of a 1-based column (bijective base 26; seven letters name every int)."""
    rest, letters = position.cast("long"), []
    for _ in range(7):
        letters.append(F.when(rest > 0, F.char(F.lit(65) + F.pmod(rest - 1, F.lit(26)))).otherwise(""))
        rest = F.floor((rest - 1) / 26)
    return F.concat(*reversed(letters))


def range_label(row_start: Column, row_end: Column, col_start: Column, col_end: Column) -> Column:
    """F10."""
    return F.concat(column_letters(col_start), row_start.cast("string"), F.lit(":"), column_letters(col_end),
                    row_end.cast("string"))


def measure_column_meta(column: Column, measure: Column) -> dict[str, Column]:
    """what a measure header says about treatment level and replicate."""
    key = F.lower(strip(column))
    level = r"^(n_\d+)(?:_([a-z0-9]+))?$"  # fixed value: nitrogen level columns, n_40 or n_40_b
    roman = r"^(i{1,3}|iv|v|vi{0,3}|ix|x)[._]"  # fixed value: roman replicate prefixes, ii. or ii_
    has_level = key.rlike(level)
    return {
        "meaning": F.when(has_level, F.coalesce(measure, F.lit("yield"))).otherwise(measure),
        "treatment": F.when(has_level, F.regexp_extract(key, level, 1)),
        "replicate_column_code": F.when(has_level, F.nullif(F.regexp_extract(key, level, 2), F.lit(""))),
        "replicate": F.when(~has_level & key.rlike(roman),
                            F.concat(F.upper(F.regexp_extract(key, roman, 1)), F.lit("."))),
    }


def allowed_or_null(c: Column, allowed: tuple[str, ...]) -> Column:
    """F18."""
    s = strip(c)
    return F.when(s.isin(*allowed), s)


def optional_text(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def make_unique_headers(df: DataFrame, keys: list[str], header: str, position: str) -> DataFrame:
    """the n-th repeat of a header inside a block gets the suffix _n (n >= 2)."""
    order = Window.partitionBy(*keys, header).orderBy(position)  # as many rows as one table has equal headers
    number = F.row_number().over(order)
    unique = F.when(number == 1, F.col(header)).otherwise(F.concat(F.col(header), F.lit("_"), number.cast("string")))
    return df.withColumn(header, unique)
