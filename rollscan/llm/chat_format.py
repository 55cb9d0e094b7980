"""Chat formatting: records of different layouts become canonical turns, then one marked text.

A record is a JSON object.  Its layout is found by a fingerprint: the hash of
those of its nested field paths that any mapping reads, whatever the values and
whatever other fields it has.  Each known layout is a declarative ``Mapping``:
the paths it needs, those it can take as well, the schema to read and an
expression that gives the turns.  The template then marks turns and escapes
control strings inside roles and texts reversibly, and says for every segment
whether the loss covers it (assistant texts).  Records that no mapping fits are
counted by the fingerprint of all their paths (``unmapped_layouts``).

Everything is DataFrame expressions on one row per conversation; nothing but
the counts of unmapped layouts is shuffled or exploded.

Defined results: a null, unreadable or unknown record has null ``layout`` and
``turns`` and an empty formatted text; a text that is an object or a list is no
text, so its record is unknown; fields that no mapping reads are left behind;
null texts and roles are empty; an empty list of turns gives an empty formatted
text; repeated records are formatted each; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string of the common templates (fixed values).
CONTROL_REST = r"/?s>|/?INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths it needs and may have besides, the schema to read, and the turns of the parsed record."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: Callable[[Column], Column]
    optional: tuple[str, ...] = ()

    def layouts(self) -> list[str]:
        """Every set of paths that the mapping fits, as the text that is hashed."""
        extra = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [joined_paths([*self.paths, *c]) for c in extra]


def joined_paths(paths: list[str]) -> str:
    return ",".join(sorted(paths))


def turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def speaker(name: Column) -> Column:
    """Role of a ``from`` field."""
    return F.when(name == "human", "user").when(name == "gpt", ASSISTANT).otherwise(name)


def with_input(r: Column) -> Column:
    more = F.coalesce(r["input"], F.lit(""))
    return F.concat(F.coalesce(r["instruction"], F.lit("")), F.when(more == "", "").otherwise(F.concat(F.lit("\n\n"), more)))


def opened_by_system(r: Column, turns: Column) -> Column:
    """The turns, after a system turn if the record has a system text."""
    return F.when(F.coalesce(r["system"], F.lit("")) == "", turns).otherwise(F.concat(F.array(turn("system", r["system"])), turns))


MAPPINGS = (
    Mapping(
        "messages", ("messages[].role", "messages[].content"), "messages array<struct<role:string,content:string>>, system string",
        lambda r: opened_by_system(r, F.transform(r["messages"], lambda m: turn(m["role"], m["content"]))), ("system",),
    ),
    Mapping(
        "from-value", ("conversations[].from", "conversations[].value"), "conversations array<struct<from:string,value:string>>, system string",
        lambda r: opened_by_system(r, F.transform(r["conversations"], lambda m: turn(speaker(m["from"]), m["value"]))), ("system",),
    ),
    Mapping(
        "prompt", ("prompt", "response"), "prompt string, response string",
        lambda r: F.array(turn("user", r["prompt"]), turn(ASSISTANT, r["response"])),
    ),
    Mapping(
        "system-prompt", ("system", "prompt", "response"), "system string, prompt string, response string",
        lambda r: F.array(turn("system", r["system"]), turn("user", r["prompt"]), turn(ASSISTANT, r["response"])),
    ),
    Mapping(
        "instruction", ("instruction", "input", "output"), "instruction string, input string, output string, system string",
        lambda r: opened_by_system(r, F.array(turn("user", with_input(r)), turn(ASSISTANT, r["output"]))), ("system",),
    ),
    Mapping(
        "instruction-only", ("instruction", "output"), "instruction string, output string, system string",
        lambda r: opened_by_system(r, F.array(turn("user", F.coalesce(r["instruction"], F.lit(""))), turn(ASSISTANT, r["output"]))), ("system",),
    ),
)

#: Levels of objects and lists inside a message that are told apart.
NESTED_LEVELS = 6


def present_paths(record: Column, mappings: tuple) -> Column:
    """Those of the mappings' paths that a JSON record (variant) has, joined in order; null if it is no object."""
    known = sorted({p for m in mappings for p in (*m.paths, *m.optional)})
    shape = lambda path: F.schema_of_variant(F.try_variant_get(record, f"$.{path}", "variant"))
    nested = r"^(OBJECT|ARRAY)<"

    def fields(of: str) -> Column:
        """Fields of the objects in a list, with their types; objects and lists inside are one word."""
        inner = F.regexp_extract(shape(of), r"^ARRAY<OBJECT<(.*)>>$", 1)
        for _ in range(NESTED_LEVELS):
            inner = F.regexp_replace(inner, r"(OBJECT|ARRAY)<[^<>]*>", "NESTED")
        return inner

    def has(path: str) -> Column:
        of, listed, name = path.partition("[].")
        if listed:
            return (shape(of) == "ARRAY<VOID>") | fields(of).rlike(rf"(^|, ){name}: (?!NESTED)")
        return shape(path).isNotNull() & ~shape(path).rlike(nested)

    found = F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in known]))
    return F.when(F.schema_of_variant(record).rlike("^OBJECT<"), F.array_join(found, ","))


def fingerprint(record: Column) -> Column:
    """Hash of all nested field paths of a JSON record; value types and array lengths don't matter."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.xxhash64(F.regexp_replace(shape, r"(?<=[:<] ?)(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)|VARIANT)", ""))


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple = MAPPINGS) -> DataFrame:
    """``records`` with ``layout`` and ``turns`` (array of role and text)."""
    mark = F.col("fingerprint_")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        same = mark.isin(*[F.xxhash64(F.lit(paths)) for paths in m.layouts()])
        layout = F.when(same, m.name).otherwise(layout)
        turns = F.when(same, m.turns(F.from_json(record, m.schema))).otherwise(turns)
    paths = present_paths(F.try_parse_json(F.col(record)), mappings)
    out = records.withColumn("fingerprint_", F.when(paths.isNotNull(), F.xxhash64(paths)))
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("fingerprint_")


def unmapped_layouts(turned: DataFrame, record: str = "record") -> DataFrame:
    """Records without a layout: fingerprint of all their paths (null if unreadable), how many, and one of them."""
    lost = turned.where(F.col("layout").isNull()).select(F.when(F.try_parse_json(F.col(record)).isNotNull(), fingerprint(F.col(record))).alias("fingerprint"), F.col(record).alias("example"))
    return lost.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"), F.min("example").alias("example"))


def escape(text: Column) -> Column:
    """One backslash more inside every control string, so none is left as it stands."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL_REST})", r"$1$2$3")


def escape_role(role: Column) -> Column:
    """A role is one line: line ends are written as %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(turned: DataFrame) -> DataFrame:
    """``turned`` with ``segments`` (text and whether the loss covers it) and ``formatted``, their texts in a row."""
    one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = lambda t: F.array(
        one(F.concat(F.lit(TURN_START), escape_role(t["role"]), F.lit("\n")), F.lit(False)),
        one(escape(t["text"]), t["role"] == ASSISTANT),
        one(F.lit(TURN_END), F.lit(False)),
    )
    segments = F.flatten(F.transform("turns", pieces))
    nothing = F.array().cast("array<struct<text:string,loss:boolean>>")
    out = turned.withColumn("segments", F.coalesce(segments, nothing))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_formatted(formatted: Column) -> Column:
    """The turns back from a formatted text."""
    marked = F.split(formatted, F.lit("<\\|im_end\\|>\n"))
    marked = F.slice(marked, F.lit(1), F.size(marked) - 1)
    bare = F.transform(marked, lambda m: F.substr(m, F.lit(len(TURN_START) + 1)))

    def back(m: Column) -> Column:
        role = F.substring_index(m, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(m, F.length(role) + 2)).alias("text"))

    return F.transform(bare, back)


def loss_text(segments: str) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
