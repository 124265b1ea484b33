"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths and mapped to canonical turns.

Only DataFrame and SQL functions are used. A layout is a set of field paths plus the turns that they hold; its fingerprint is
the hash of the sorted paths. A frame is matched by the paths of its schema, a JSON record by the paths of its own value (a
field of an array's elements counts if any element has it), in both cases without regard to fields that no layout knows. Where
no fingerprint is the same, the layout with the most paths among them all is taken. A ``system`` field becomes the first
turn in every layout. Records without a layout are listed by ``rejected_records``.

The template writes ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break for each turn. In texts and
roles a backslash is doubled, then ``<|`` becomes ``<\\|``, and in roles a line break becomes ``<\\n>``; what stands between
two marks can so hold no mark, and reading back is exact. ``loss`` lists (start, length) of every assistant text in the
formatted string.

Defined cases: a null text or role is empty; null elements of a turn array are no turns; turns are ordered by number (null first), then role, then text, repeated rows
stay; a null conversation id is one conversation; an empty table gives an empty result. A conversation is one row of the
result, so its turns meet in one task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

# fixed values: field names of common layouts and their role names
START, END = "<|im_start|>", "<|im_end|>"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Field paths, and where the turns are: rows of a table, an array of turns, or single fields by role."""

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None  # conversation, turn, role, text
    array: tuple[str, str, str] | None = None  # array, role, text
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role and the fields that make up its text

    @property
    def fingerprint(self) -> int:
        return fingerprint_of(self.paths)


def fingerprint_of(paths) -> int:
    return zlib.crc32("\n".join(sorted(paths)).encode())


LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages", "messages.role", "messages.content"), array=("messages", "role", "content")),
    Layout("dialogue", ("conversations", "conversations.from", "conversations.value"),
           array=("conversations", "from", "value")),
    Layout("prompt", ("prompt", "completion"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "input", "output"),
           fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_only", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("system_prompt", ("system", "prompt", "response"),
           fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)
ROW_PATHS = frozenset(p for layout in LAYOUTS if layout.rows for p in layout.paths)
RECORD_PATHS = frozenset(p for layout in LAYOUTS if not layout.rows for p in layout.paths)
BY_PRINT = {layout.fingerprint: layout for layout in LAYOUTS}


def schema_paths(schema: StructType, prefix: str = "") -> list[str]:
    """All nested field paths; arrays do not count as a level."""
    found = []
    for field in schema.fields:
        path, kind = prefix + field.name, field.dataType
        while isinstance(kind, ArrayType):
            kind = kind.elementType
        found += [path, *(schema_paths(kind, path + ".") if isinstance(kind, StructType) else ())]
    return found


def by_size() -> list[Layout]:
    """Record layouts, those of most paths first; of equals the order of ``LAYOUTS``."""
    return sorted((layout for layout in LAYOUTS if not layout.rows), key=lambda layout: -len(layout.paths))


def layout_of(df: DataFrame) -> Layout:
    """The layout of a frame: by the fingerprint of its field paths or the most of them, those that records know before those
    of turn rows."""
    paths = set(schema_paths(df.schema))
    for known, layouts in ((RECORD_PATHS, by_size()), (ROW_PATHS, [layout for layout in LAYOUTS if layout.rows])):
        layout = BY_PRINT.get(fingerprint_of(known & paths)) or next((x for x in layouts if paths >= set(x.paths)), None)
        if layout is not None:
            return layout
    raise ValueError(f"no layout has the field paths {sorted(paths)}")


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _role(column: Column) -> Column:
    out = _text(column)
    for name, canonical in ROLES.items():
        out = F.when(_text(column) == name, canonical).otherwise(out)
    return out


def _joined(columns: list[Column]) -> Column:
    """Fields that are not empty, one below the other."""
    return F.array_join(F.filter(F.array(*[_text(c) for c in columns]), lambda t: t != ""), "\n")


def field_turns(layout: Layout, get) -> Column:
    """The turns of a layout of single fields; a role without text has no turn. ``get`` turns a field name into a column."""
    turns = F.array(*[F.struct(F.lit(role).alias("role"), _joined([get(f) for f in fields]).alias("text"))
                      for role, fields in layout.fields])
    return F.filter(turns, lambda t: t["text"] != "")


def with_system(layout: Layout, turns: Column, system: Column) -> Column:
    """The turns after a system turn, where the record has a text for one that the layout itself does not place."""
    if any(role == "system" for role, _ in layout.fields):
        return turns
    first = F.array(F.struct(F.lit("system").alias("role"), _text(system).alias("text")))
    return F.when(_text(system) != "", F.concat(first, turns)).otherwise(turns)


def array_turns(array: Column, role: str, text: str) -> Column:
    return F.transform(F.filter(array, lambda t: t.isNotNull()), lambda t: F.struct(_role(t[role]).alias("role"), _text(t[text]).alias("text")))


def canonical_turns(df: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (order inside the conversation), ``role``, ``text``: one row per turn, from any known layout.

    Layouts without conversation ids take the input column ``conv_id`` if there is one, else a number per row.
    """
    layout = layout_of(df)
    if layout.rows:
        conversation, turn, role, text = layout.rows
        return df.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("place"),
                         _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"))
    number = F.col("conv_id") if "conv_id" in df.columns else F.monotonically_increasing_id()
    if layout.array:
        array, role, text = layout.array
        turns = array_turns(F.col(array), role, text)
    else:
        turns = field_turns(layout, F.col)
    if "system" in schema_paths(df.schema):
        turns = with_system(layout, turns, F.col("system"))
    return df.select(number.alias("conv_id"), F.posexplode(turns).alias("place", "turn")).select(
        "conv_id", F.col("place").cast("long").alias("place"), "turn.role", "turn.text")


def record_paths(value: Column) -> Column:
    """Sorted known field paths of a variant; a field of array elements is there if any element has it."""
    def there(path: str) -> Column:
        outer, _, field = path.partition(".")
        if not field:
            return F.schema_of_variant(F.try_variant_get(value, f"$.{outer}", "variant")).isNotNull()
        elements = F.try_variant_get(value, f"$.{outer}", "array<variant>")
        return F.coalesce(F.exists(elements, lambda e: F.schema_of_variant(F.try_variant_get(e, f"$.{field}", "variant"))
                                   .isNotNull()), F.lit(False))

    return F.array_compact(F.array(*[F.when(there(p), F.lit(p)) for p in sorted(RECORD_PATHS)]))


def _recognised(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """``conv_id``, ``_value``, ``_paths``, the fingerprint ``_print`` and the name of the layout, null without one."""
    value = F.try_parse_json(F.col(json_column).cast("string"))
    records = df.select(F.col(id_column).alias("conv_id"), value.alias("_value")).withColumn(
        "_paths", record_paths(F.col("_value"))).withColumn(
        "_print", F.crc32(F.array_join("_paths", "\n").cast("binary")))
    same = [F.when(F.col("_print") == layout.fingerprint, layout.name) for layout in by_size()]
    most = [F.when(F.size(F.array_except(F.array(*map(F.lit, layout.paths)), "_paths")) == 0, layout.name)
            for layout in by_size()]
    return records.withColumn("_layout", F.coalesce(*same, *most))


def canonical_records(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """As ``canonical_turns``, from JSON records of mixed layouts; ``rejected_records`` has the others."""
    records = _recognised(df, id_column, json_column)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    get = lambda path, kind="string": F.try_variant_get("_value", "$." + path, kind)
    for layout in by_size():
        if layout.array:
            array, role, text = layout.array
            each = get(array, "array<variant>")
            own = F.transform(F.filter(each, lambda t: t.isNotNull() & ~F.is_variant_null(t)), lambda t: F.struct(
                _role(F.try_variant_get(t, f"$.{role}", "string")).alias("role"),
                _text(F.try_variant_get(t, f"$.{text}", "string")).alias("text")))
        else:
            own = field_turns(layout, get)
        turns = F.when(F.col("_layout") == layout.name, with_system(layout, own, get("system"))).otherwise(turns)
    return records.select("conv_id", F.posexplode(turns).alias("place", "turn")).select(
        "conv_id", F.col("place").cast("long").alias("place"), "turn.role", "turn.text")


def rejected_records(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """``conv_id``, ``fingerprint`` of the known field paths, ``paths`` and ``readable`` of the records without a layout."""
    return _recognised(df, id_column, json_column).where("_layout IS NULL").select(
        "conv_id", F.col("_print").alias("fingerprint"), F.col("_paths").alias("paths"),
        F.col("_value").isNotNull().alias("readable"))


def escaped(column: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("<\\n>")) if role else out


def unescaped(column: Column, role: bool = False) -> Column:
    out = F.replace(column, F.lit("<\\n>"), F.lit("\n")) if role else column
    return F.replace(F.replace(out, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss`` of every conversation of canonical turns."""
    head = F.concat(F.lit(START), escaped(F.col("role"), True), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = turns.select("conv_id", "place", "role", "text", head.alias("_head"), body.alias("_body")).withColumn(
        "_piece", F.concat("_head", "_body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("place", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_at", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0).cast("long")))
    span = F.when(F.col("role") == "assistant",
                  F.struct((F.col("_at") + F.length("_head") + 1).cast("long").alias("start"),
                           F.length("_body").cast("long").alias("length")))
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_pieces"),
        F.sort_array(F.collect_list(span)).alias("loss"))
    return gathered.select("conv_id", F.array_join(F.col("_pieces")["_piece"], "").alias("formatted"), "loss")


def read_back(conversations: DataFrame) -> DataFrame:
    """``turns`` (array of role and text) and ``loss_text``, read from ``formatted`` and ``loss`` alone."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda part, place: place > 0)

    def turn(part):
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescaped(role, True).alias("role"), unescaped(text).alias("text"))

    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"].cast("int"),
                                                                 s["length"].cast("int"))))
    return conversations.select("*", F.transform(parts, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))
