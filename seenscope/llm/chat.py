"""Chat formatting with schema fingerprints, in DataFrame functions only.

Layouts. Records come as tables of any shape, as tables with one row per turn, or as JSON texts
of mixed shapes. A layout is a set of nested field paths and a declarative mapping to canonical
turns, an array of ``(role, text)``. Of the layouts whose paths a table or record has, the first
in ``LAYOUTS`` claims them; the fingerprint, a hash of the claimed paths, selects the mapping.
Other fields are ignored, whether or not another layout knows them: ``messages`` stand before
``instruction`` with ``input``, and that before pairs such as ``prompt`` and ``completion``. A
field ``system`` beside any of them becomes the first turn.

Template. A turn is ``<|role|>``, a line feed, the text, ``<|end|>`` and a line feed. Control
strings of this and of other common templates inside a text or role are broken up by percent
codes, and so is a percent sign before such a code; reading back undoes exactly that. Other
text is left as it is. The loss mask holds the place of every assistant text.

Null texts and roles count as empty ones. Turns are ordered by their number, then role and
text; a null number comes first and repeated rows stay. An empty table gives an empty result.
A conversation is one training example and hence one row; rows of different conversations are
aggregated on the map side and shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

ASSISTANT = "assistant"
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role: string, text: string>>"
# Names of roles in other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
# What is escaped: codes themselves, and the first sign of a control string.
_CODE = r"%(?=25|3C|5B|7C)"
_ANGLE = r"<(?=\||/?s>|</?SYS>>)"
_SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, _CODE, "%25")
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, "%3C"), _SQUARE, "%5B")


def unescape(text: Column) -> Column:
    for code, sign in (("%3C", "<"), ("%5B", "["), ("%7C", "|"), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _role(text: Column) -> Column:
    return F.replace(escape(text), F.lit("|"), F.lit("%7C"))


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout, and the turns made of a function that gives a path's value."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column]

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def _joined(paths: Iterable[str]) -> str:
    return ",".join(sorted(paths))


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256(_joined(paths).encode()).hexdigest()


def _turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _single(*fields: str) -> Callable:
    """One user turn of all fields but the last, which is the answer."""

    def turns(get):
        asked = F.concat_ws("\n\n", *[F.nullif(get(f), F.lit("")) for f in fields[:-1]])
        return F.array(_turn("user", asked), _turn(ASSISTANT, get(fields[-1])))

    return turns


def _list(field: str, role: str, text: str) -> Callable:
    """A turn per element of a list."""

    def turns(get):
        known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        name = lambda m: F.coalesce(known[F.lower(m[role])], m[role], F.lit(""))
        return F.coalesce(F.transform(get(f"{field}[]"), lambda m: _turn(name(m), m[text])), F.array().cast(TURNS))

    return turns


def _row(get) -> Column:
    """The turn that a row of a turn table holds."""
    return F.array(_turn(F.coalesce(get("role"), F.lit("")), get("text")))


def _after_system(turns: Callable) -> Callable:
    def after(get):
        first = F.when(get("system").isNotNull(), F.array(_turn("system", get("system")))).otherwise(F.array().cast(TURNS))
        return F.concat(first, turns(get))

    return after


TURN_ROWS = Layout("turn-rows", ("turn", "role", "text"), _row)
LISTS = {"messages": ("role", "content"), "conversations": ("from", "value")}
_RECORDS = [
    *[Layout(x, tuple(f"{x}[].{f}" for f in fields), _list(x, *fields)) for x, fields in LISTS.items()],
    *[
        Layout("-".join(fields), fields, _single(*fields))
        for fields in (
            ("instruction", "input", "output"),
            ("instruction", "output"),
            ("instruction", "response"),
            ("prompt", "completion"),
            ("prompt", "response"),
            ("question", "answer"),
        )
    ],
]
# From the one that claims its fields first to the last.
RECORDS = [
    x
    for layout in _RECORDS
    for x in (Layout(f"system-{layout.name}", ("system", *layout.paths), _after_system(layout.turns)), layout)
]
LAYOUTS = [TURN_ROWS, *RECORDS]
BY_FINGERPRINT = {x.fingerprint: x for x in LAYOUTS}
KNOWN_PATHS = sorted({p for layout in RECORDS for p in layout.paths})


def paths_of(kind: DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; a list adds ``[]``."""
    if isinstance(kind, StructType):
        return [p for f in kind for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, ArrayType):
        return paths_of(kind.elementType, prefix + "[]")
    return [prefix]


def schema_fingerprint(paths: Iterable[str]) -> str:
    """Hash of the paths that a layout claims, or of all if none does."""
    there = set(paths)
    return fingerprint(next((x.paths for x in LAYOUTS if there.issuperset(x.paths)), there))


def canonical_table(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, turns)`` of a table in any known layout, or with one row per turn.

    Null values count as empty, and a null ``system`` adds no turn. Records stay one row each,
    also if they repeat a key. Turn rows of one key, null like any other, are one conversation.
    """
    paths = paths_of(df.schema)
    layout = BY_FINGERPRINT.get(schema_fingerprint(paths))
    if layout is None:
        raise ValueError(f"no layout for the fields {', '.join(paths)}")

    def get(path: str) -> Column:
        if not path.endswith("[]"):
            return F.col(path).cast("string")
        field = path.removesuffix("[]")
        return F.transform(F.col(field), lambda m: F.struct(*[m[x].cast("string").alias(x) for x in LISTS[field]]))

    turns = layout.turns(get).cast(TURNS).alias("turns")
    if layout is not TURN_ROWS:
        return df.select(key, turns)
    # Ordered by number, then role and text.
    numbered = F.struct(F.col("turn").cast("long").alias("turn"), turns[0].alias("said"))
    rows = df.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(numbered)).alias("turns"))
    return rows.select(key, F.transform("turns", lambda t: t["said"]).alias("turns"))


def canonical_json(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` and ``turns`` of a JSON text per row.

    Each row may have another layout, and a record may have the fields of several. Fields are
    known by their values: a null one counts as absent, a list's field as there if any element
    has it. Text that is not JSON, null or of no known layout has a null layout and null turns,
    and the fingerprint of what known paths it has. Columns of these names are replaced.
    """
    value = F.try_parse_json(F.col(record))

    def get(path: str) -> Column:
        if not path.endswith("[]"):
            return F.try_variant_get(value, f"$.{path}", "string")
        field = path.removesuffix("[]")
        kind = ", ".join(f"{x}: string" for x in LISTS[field])
        return F.try_variant_get(value, f"$.{field}", f"array<struct<{kind}>>")

    def has(path: str) -> Column:
        if "[]." not in path:
            return get(path).isNotNull()
        field, leaf = path.split("[].")
        return F.coalesce(F.exists(get(f"{field}[]"), lambda m: m[leaf].isNotNull()), F.lit(False))

    there = F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in KNOWN_PATHS]))
    found = df.withColumn("fingerprint", there)
    claimed = [
        F.when(F.forall(F.array(*[F.lit(p) for p in x.paths]), lambda p: F.array_contains("fingerprint", p)), F.lit(_joined(x.paths)))
        for x in RECORDS
    ]
    found = found.withColumn("fingerprint", F.sha2(F.coalesce(*claimed, F.array_join("fingerprint", ",")), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in RECORDS:
        chosen = F.col("fingerprint") == x.fingerprint
        layout = F.when(chosen, F.lit(x.name)).otherwise(layout)
        turns = F.when(chosen, x.turns(get).cast(TURNS)).otherwise(turns)
    return found.withColumns({"layout": layout, "turns": turns})


def render(turns: Column) -> Column:
    """The formatted text of an array of turns."""
    one = lambda t: F.concat(F.lit(OPEN), _role(t["role"]), F.lit(CLOSE), escape(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def loss_mask(turns: Column) -> Column:
    """``(start, length)`` of every assistant text in the formatted text, from 1."""

    def step(acc, t):
        head = F.length(_role(t["role"])) + len(OPEN) + len(CLOSE)
        size = F.length(escape(t["text"]))
        span = F.array(F.struct((acc["at"] + head).alias("start"), size.alias("length")))
        spans = F.when(t["role"] == ASSISTANT, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + size + len(END)).alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start: int, length: int>>")
    return F.aggregate(turns, F.struct(F.lit(1).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def format_chats(turns: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` to rows with canonical ``turns``."""
    return turns.withColumns({"formatted": render(F.col("turns")), "loss_mask": loss_mask(F.col("turns"))})


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(formatted, r"<\|end\|>\n")
    bodies = F.slice(parts, 1, F.size(parts) - 1)

    def turn(body):
        at = F.instr(body, CLOSE)
        role = F.substring(body, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(body, at + len(CLOSE), F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and digests, read back from ``formatted`` and ``loss_mask``."""
    turns = read_back(F.col("formatted"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    loss = F.array_join(masked, "")
    return formatted.select(
        key,
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
