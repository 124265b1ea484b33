"""Text folding, tokens, snippets and small formatters."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallgrid.functions.values import WHITESPACE, strip

SNIPPET = 220


def _decomposed(char: str) -> str:
    """A character's case-folded decomposition without marks; what is not ASCII becomes a blank."""
    parts = unicodedata.normalize("NFKD", char.casefold())
    return "".join(p if p.isascii() else " " for p in parts if not unicodedata.combining(p))


def _plain(char: str) -> str:
    return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()


@lru_cache
def fold_tables(fold) -> tuple[str, str, str, str]:
    """(from, to) of one-letter folds, the characters that fold to nothing, and the longer folds as ``a\x01bc\x02...``.

    All code points beyond ASCII take part, as the Unicode database decomposes them.
    """
    single, nothing, longer = [], [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        folded = fold(char)
        if len(folded) == 1 and (fold is _plain or folded != " "):
            single.append((char, folded))
        elif not folded and fold is _decomposed:
            nothing.append(char)
        elif len(folded) > 1 and (fold is _plain or (folded.strip() and char.lower() == char)):
            longer.append((char, folded))
    return "".join(a for a, _ in single), "".join(b for _, b in single), "".join(nothing), "\x02".join(
        f"{a}\x01{b}" for a, b in longer)


ASCII = "".join(chr(i) for i in range(1, 128))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _only_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _unfold(c: Column, longer: str) -> Column:
    """Characters that fold to several letters; texts without any stay as they are."""
    chars = "".join(entry[0] for entry in longer.split("\x02"))
    table = F.str_to_map(F.lit(longer), F.lit("\x02"), F.lit("\x01"))
    letters = F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch))
    return F.when(c.rlike(f"[{chars}]"), F.array_join(letters, "")).otherwise(c)


def _fold_words(c: Column, kept: str) -> Column:
    """Folded words of the kept ASCII characters, one blank between them.

    One character table does nearly all the work; folds to several letters and the removal of other scripts only
    touch texts that are not plain ASCII by then.
    """
    source, target, nothing, longer = fold_tables(_decomposed)
    other = "".join(ch for ch in ASCII if ch not in kept and not ch.isalnum() and ch != " ")
    target = "".join(t if t in kept or t.isdigit() or t.islower() else " " for t in target)
    sharp = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))  # the one longer fold that common texts hold
    mapped = F.translate(sharp, source + other + nothing, target + " " * len(other))
    allowed = "a-z0-9" + re.escape(kept)
    plain = bind(mapped, lambda m: F.when(_only_ascii(m), m).otherwise(
        F.regexp_replace(_unfold(m, longer), f"[^{allowed} ]", " ")))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def squeeze(c: Column) -> Column:
    blanks = F.translate(c, WHITESPACE, " " * len(WHITESPACE))
    return F.trim(F.regexp_replace(blanks, " {2,}", " "))


def fold_question(c: Column) -> Column:
    """F19 for questions: words of letters, digits, % and /."""
    return _fold_words(c, "%/")


def fold_document(c: Column) -> Column:
    """F19 for retrieval: also keeps dot, underscore and hyphen."""
    return _fold_words(c, "%/._-")


def fold_ascii(c: Column) -> Column:
    """accents dropped, other non-ASCII removed, punctuation kept."""
    source, target, _, longer = fold_tables(_plain)
    folded = F.translate(_unfold(c, longer), source, target)
    kept = F.when(_only_ascii(c), c).otherwise(F.regexp_replace(folded, r"[^\x00-\x7f]", ""))
    return squeeze(F.lower(kept))


def tokens(folded: Column) -> Column:
    """distinct tokens of two or more characters of an already folded text."""
    return F.filter(F.array_distinct(F.split(folded, " ")), lambda t: F.length(t) >= 2)


def snippet(text: Column, query_tokens: Column) -> Column:
    """up to 220 characters around the first token hit."""
    def first_hit(folded: Column) -> Column:
        places = F.transform(query_tokens, lambda t: F.instr(folded, t))
        return F.array_min(F.filter(places, lambda p: p > 0)) - 1

    def cut(cleaned: Column, first: Column) -> Column:
        start = F.greatest(first - 40, F.lit(0))
        end = F.least(start + SNIPPET, F.length(cleaned))
        window = F.trim(F.substring(cleaned, start + 1, F.lit(SNIPPET)))
        around = F.concat(F.when(start > 0, "...").otherwise(""), window,
                          F.when(end < F.length(cleaned), "...").otherwise(""))
        whole = first.isNull() | (F.length(cleaned) <= SNIPPET)
        return F.when(whole, F.substring(cleaned, 1, SNIPPET)).otherwise(around)

    return bind(squeeze(text), lambda cleaned: bind(bind(fold_document(cleaned), first_hit),
                                                    lambda first: cut(cleaned, first)))


PAIR = "struct<left:string,right:string>"


def _longest_block(left: Column, right: Column) -> Column:
    """(size, first, at) of the longest common block: the earliest in ``left`` (``first`` is minus its place), then in ``right``."""
    def block(i: Column, size: Column) -> Column:
        at = F.instr(right, F.substring(left, i, size))
        return F.struct(F.when(at > 0, size).otherwise(0).alias("size"), (-i).alias("first"), at.alias("at"))

    places = F.sequence(F.lit(1), F.length(left))
    return F.array_max(F.flatten(F.transform(places, lambda i: F.transform(
        F.sequence(F.lit(1), F.length(left) - i + 1), lambda size: block(i, size)))))


def matching_letters(left: Column, right: Column) -> Column:
    """Letters in matching blocks: the longest common block, then in the same way what lies before it and what lies behind it.

    The parts still to be compared wait in an array; each step takes one, so twice the shorter length bounds the steps.
    """
    state = f"struct<parts:array<{PAIR}>,total:int>"
    part = lambda a, b: F.struct(a.alias("left"), b.alias("right"))
    made = lambda parts, total: F.struct(parts.alias("parts"), total.cast("int").alias("total")).cast(state)

    def split(now: Column, top: Column, block: Column) -> Column:
        rest = F.slice(now["parts"], F.lit(2), F.size(now["parts"]))
        i, j, size = -block["first"], block["at"], block["size"]
        before = part(F.substring(top["left"], F.lit(1), i - 1), F.substring(top["right"], F.lit(1), j - 1))
        behind = part(F.substring(top["left"], i + size, F.length(top["left"])),
                      F.substring(top["right"], j + size, F.length(top["right"])))
        new = F.filter(F.array(before, behind), lambda p: (p["left"] != "") & (p["right"] != ""))
        return F.when(size == 0, made(rest, now["total"])).otherwise(made(F.concat(new, rest), now["total"] + size))

    def step(now: Column, _: Column) -> Column:
        return F.when(F.size(now["parts"]) == 0, now).otherwise(bind(F.element_at(now["parts"], 1), lambda top: bind(
            _longest_block(top["left"], top["right"]), lambda block: split(now, top, block))))

    shorter = F.least(F.length(left), F.length(right))
    steps = F.sequence(F.lit(0), 2 * shorter)
    return F.when(shorter > 0, F.aggregate(steps, made(F.array(part(left, right)), F.lit(0)), step)["total"]).otherwise(0)


def shared_letters(left: Column, right: Column) -> Column:
    """Letters that both have, as often as both have them: an upper bound of ``matching_letters``."""
    times = lambda text, letter: F.length(text) - F.length(F.replace(text, letter, F.lit("")))
    letters = F.array_distinct(F.split(left, ""))
    return F.aggregate(F.filter(letters, lambda a: a != ""), F.lit(0), lambda n, a: n + F.least(times(left, a), times(right, a)))


def join_counts(pairs: Column) -> Column:
    """``k=n`` pairs of an array of (k, n) structs, sorted by key, positive counts only."""
    kept = F.array_sort(F.filter(pairs, lambda p: p["n"] > 0))
    return F.array_join(F.transform(kept, lambda p: F.concat_ws("=", p["k"], p["n"].cast("string"))), ", ")


def display_text(c: Column, fallback: str = "n/a") -> Column:
    """F27."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(fallback))


def format_metric(value: Column, unit: Column) -> Column:
    """value with its unit."""
    return F.concat_ws(" ", display_text(value), F.nullif(display_text(unit, ""), F.lit("")))


def join_sentences(parts: Column) -> Column:
    """trimmed parts without closing dots, joined as sentences."""
    kept = F.filter(parts, lambda p: p.isNotNull() & (strip(p) != ""))
    body = F.array_join(F.transform(kept, lambda p: F.regexp_replace(strip(p), r"\.+$", "")), ". ")
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(body, F.lit(".")))


def metadata_text(metadata: Column) -> Column:
    """F28 for a map of text values."""
    return F.array_join(F.flatten(F.transform(F.map_entries(metadata), lambda e: F.array(e["key"], e["value"]))),
                        " ")


def public_fields(metadata: Column) -> Column:
    """map without its internal (underscore) keys."""
    return F.map_filter(metadata, lambda k, v: ~k.startswith("_"))


def substring_positions(text: Column, size: int) -> Column:
    """All character windows of one size in a text (used as equi-join keys for substring matching)."""
    last = F.length(text) - (size - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))) \
        .otherwise(F.array().cast("array<string>"))
