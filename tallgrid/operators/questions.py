"""Tagging of question tables. Rule set A matches words as substrings, rule set B as whole words."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrid import catalog
from tallgrid.functions import text as x
from tallgrid.functions import units
from tallgrid.operators import matching

VALUE_FIELDS = ("variety", "location", "treatment", "plot_id")
MATCH_PERCENT = 72  # fixed value


def _folded_keyword(keyword: str) -> str:
    return re.sub("[^a-z0-9%/]+", " ", keyword).strip()


def has_substring(question: Column, keywords) -> Column:
    return units.contains_any(question, [_folded_keyword(k) for k in keywords])


def has_word(question: Column, keywords) -> Column:
    """Whole-word test of an ASCII-folded question; accented keywords cannot occur in it."""
    plain = [re.escape(k) for k in keywords if k.isascii()]
    return question.rlike(f"(?<![a-z0-9_])(?:{'|'.join(plain)})(?![a-z0-9_])") if plain else F.lit(False)


def _first(question: Column, rules: dict, test) -> Column:
    out = None
    for name, keywords in rules.items():
        hit = test(question, keywords)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def _all(question: Column, rules, test) -> Column:
    return F.array_compact(F.array(*[F.when(test(question, keywords), F.lit(name)) for name, keywords in rules]))


def match_values(folded: DataFrame, values: DataFrame, fold) -> DataFrame:
    """Per question and field the longest known value contained in it; ties go to the smaller value.

    ``folded``: (question_id, q); ``values``: (field, value) from the distinct values of the observations.
    """
    patterns = values.filter(F.col("field").isin(*VALUE_FIELDS)).withColumn("folded_value", fold(F.col("value")))
    pairs = matching.contained(folded, "q", patterns, "folded_value")
    best = F.min_by("value", F.struct(-F.length("folded_value"), F.col("value")))
    return pairs.groupBy("question_id").agg(*[
        F.min_by(F.when(F.col("field") == f, F.col("value")),
                 F.when(F.col("field") == f, F.struct(-F.length("folded_value"), F.col("value")))).alias(f"f_{f}")
        for f in VALUE_FIELDS])


def tag_a(questions: DataFrame, values: DataFrame) -> DataFrame:
    """N1-N5, rule set A: questions are (question_id, question)."""
    q = F.col("q")
    folded = questions.select("question_id", "question", x.fold_question(F.col("question")).alias("q"))
    tagged = folded.select(
        "question_id", "question", "q",
        _first(q, catalog.A_MEASURES, has_substring).alias("measure"),
        _first(q, catalog.A_GROUPS, has_substring).alias("group_by"),
        _all(q, catalog.A_STATUSES, has_substring).alias("statuses"),
        has_substring(q, catalog.A_AVERAGE).alias("has_average"),
        has_substring(q, catalog.A_TOP).alias("has_top"),
        has_substring(q, catalog.A_LIST).alias("has_list"))
    return tagged.join(match_values(folded.select("question_id", "q"), values, x.fold_question), "question_id", "left")


def date_tags(q: Column) -> dict[str, Column]:
    """An exact day, else a year; whole words."""
    day = r"(?<![A-Za-z0-9_])(20\d{2}-\d{2}-\d{2})(?![A-Za-z0-9_])"
    year = r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])"
    exact = F.regexp_extract(q, day, 1).try_cast("date")
    return {"f_day": exact, "f_year": F.when(~q.rlike(day), F.nullif(F.regexp_extract(q, year, 1), F.lit(""))
                                             .try_cast("int"))}


def limit_tag(q: Column) -> Column:
    """The number after top or first, at most three digits."""
    return F.nullif(F.regexp_extract(q, r"(?<![A-Za-z0-9_])(?:top|first)\s+(\d{1,3})(?![A-Za-z0-9_])", 1), F.lit("")) \
        .try_cast("int")


def tag_b(questions: DataFrame, values: DataFrame) -> DataFrame:
    """N1-N9, rule set B; optional columns upload_session_id and limit_override are carried along."""
    q = F.col("q")
    optional = {"upload_session_id": "string", "limit_override": "int"}
    carried = [F.col(n) if n in questions.columns else F.lit(None).cast(t).alias(n) for n, t in optional.items()]
    folded = questions.select("question_id", "question", *carried, x.fold_ascii(F.col("question")).alias("q"))
    tagged = folded.select(
        "question_id", "question", "upload_session_id", "limit_override", "q",
        _all(q, catalog.MEASURE_TOKENS.items(), has_word).alias("measures"),
        _first(q, catalog.B_GROUPS, has_word).alias("group_by"),
        _all(q, catalog.B_STATUSES, has_word).alias("statuses"),
        has_word(q, catalog.B_AVERAGE).alias("has_average"),
        has_word(q, catalog.B_COUNT).alias("has_count"),
        has_word(q, catalog.B_TOP).alias("has_top"),
        has_word(q, catalog.B_LOW).alias("has_low"),
        has_word(q, catalog.B_LIST).alias("has_list"),
        units.contains_any(q, catalog.FORBIDDEN_TERMS).alias("is_unsafe"),
        units.contains_any(q, catalog.B_ALL_DATA).alias("wants_all"),
        limit_tag(q).alias("asked_limit"), *[e.alias(n) for n, e in date_tags(q).items()])
    return tagged.join(match_values(folded.select("question_id", "q"), values, x.fold_ascii), "question_id", "left")


def _alias_catalogue() -> list[tuple[str, str, list[str]]]:
    sections = (("measure", catalog.MEASURE_TOKENS), ("dimension", catalog.DIMENSION_TOKENS),
                ("aggregation", catalog.AGGREGATION_ALIASES))
    return [(section, name, list(aliases)) for section, table in sections for name, aliases in table.items()]


def alias_rows() -> list[tuple[int, str, str, int, str, str]]:
    """(name number, section, canonical name, alias number, alias, folded alias) of the fixed catalogue."""
    plain = lambda s: " ".join(unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower().split())
    return [(i, section, name, k, alias, plain(alias)) for i, (section, name, aliases) in enumerate(_alias_catalogue())
            for k, alias in enumerate(aliases)]


def fuzzy_aliases(questions: DataFrame, max_hints: int | None = None) -> DataFrame:
    """(question_id, section, hint_no, token, canonical_name, matched_alias), the first ``max_hints`` of each section.

    Each distinct token of three or more characters is compared once with the fixed aliases. Likeness is twice the letters in
    matching blocks by the letters of both; an alias matches from ``MATCH_PERCENT`` on, and the most similar alias of every
    canonical name counts (of equals the last in alphabetic order). Lengths and shared letters rule out most pairs before.
    """
    c = F.col
    words = F.split(F.trim(F.regexp_replace(x.fold_ascii(c("question")), r"[?,\s]+", " ")), " ")
    tokens = questions.select("question_id", F.posexplode(words).alias("pos", "token")).filter(F.length("token") >= 3)
    names = ("ord", "section", "canonical_name", "alias_no", "matched_alias", "folded")
    fixed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in alias_rows()])
    pairs = tokens.select("token").distinct().select("token", F.explode(fixed).alias("a")).select("token", "a.*")
    both = F.length("token") + F.length("folded")
    enough = lambda letters: 200 * letters >= MATCH_PERCENT * both
    near = pairs.filter(enough(F.least(F.length("token"), F.length("folded")))).filter(
        enough(x.shared_letters(c("folded"), c("token"))))
    close = near.withColumn("_letters", x.matching_letters(c("folded"), c("token"))).withColumn(
        "likeness", 2.0 * c("_letters") / both).filter(enough(c("_letters")))
    best = close.groupBy("token", "ord", "section", "canonical_name").agg(
        F.max_by("matched_alias", F.struct("likeness", "folded", "alias_no")).alias("matched_alias"))
    place = Window.partitionBy("question_id", "section").orderBy("pos", "ord")
    hints = tokens.join(best, "token").withColumn("hint_no", F.row_number().over(place) - 1)
    shown = hints if max_hints is None else hints.filter(c("hint_no") < max_hints)
    return shown.select("question_id", "section", "hint_no", "token", "canonical_name", "matched_alias")
