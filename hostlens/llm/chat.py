"""Chat formatting with DataFrame functions only.

A record's layout is told by a fingerprint, a hash of its nested field paths that hold something; the
fingerprint selects a declarative mapping that makes canonical turns of prompt, instruction and message
layouts. The template marks turns; control strings inside texts are escaped so that they can be read
back, and the loss mask covers the assistant's texts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"
#: Turns of a conversation that are formatted together.
PART = 64
#: Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    Either `items` names an array of structs with the fields `role` and `text`, or `turns` lists
    (role, paths), the texts of which are joined by blank lines; turns without any text are left out.
    Roles of items get their usual names unless they stay `as_is`.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    as_is: bool = False


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), items="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("system",), items="conversations", role="from", text="value", turns=(("system", ("system",)),)),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt", ("prompt", "response"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", ("prompt", "completion"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question", ("question", "answer"), ("context",), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)

#: The same, where roles stay as they are.
AS_IS = tuple(replace(m, as_is=True) for m in MAPPINGS)


def paths(kind: T.DataType, above: str = "") -> list[str]:
    """Nested field paths of a schema, arrays marked by []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{above}.{f.name}" if above else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{above}[]")
    return [above]


def _held(path: str) -> Column:
    """Whether a path holds something: not null, and for an array's path a value in some element."""
    outer, _, inner = path.partition("[].")
    column = F.col(".".join(f"`{p}`" for p in outer.split(".")))
    if inner:
        return F.coalesce(F.exists(column, lambda x: x[inner].isNotNull()), F.lit(False))
    return column.isNotNull()


def fingerprint(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The hash of those of the mappings' paths that a row holds."""
    known = {p for m in mappings for p in (*m.needs, *m.may)}
    mine = sorted(known & set(paths(schema)))
    return F.xxhash64(F.array_join(F.array_compact(F.array(*[F.when(_held(p), F.lit(p)) for p in mine], F.lit(None).cast("string"))), "|"))


def _layouts(mapping: Mapping) -> list[Column]:
    sets = [set(mapping.needs) | set(extra) for n in range(len(mapping.may) + 1) for extra in combinations(mapping.may, n)]
    return [F.xxhash64(F.lit("|".join(sorted(s)))) for s in sets]


def _role(role: Column) -> Column:
    low = F.lower(F.coalesce(role.cast("string"), F.lit("")))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(names, low), low)


def _turns(mapping: Mapping, mine: set[str]) -> Column:
    fixed = [(role, [p for p in group if p in mine]) for role, group in mapping.turns]
    texts = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.nullif(F.col(f"`{p}`").cast("string"), F.lit("")) for p in group]).alias("text")) for role, group in fixed if group]
    out = F.filter(F.array(*texts), lambda t: t["text"] != "").cast(TURNS) if texts else F.array().cast(TURNS)
    if mapping.items:
        name = (lambda x: F.coalesce(x.cast("string"), F.lit(""))) if mapping.as_is else _role
        item = F.transform(F.filter(F.col(f"`{mapping.items}`"), lambda x: x.isNotNull()), lambda x: F.struct(name(x[mapping.role]).alias("role"), F.coalesce(x[mapping.text].cast("string"), F.lit("")).alias("text")))
        out = F.concat(out, item.cast(TURNS))
    return out


def canonical(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with layout_hash, layout and turns (array of role and text).

    A row of a layout that no mapping takes has a null layout and null turns. Null texts are empty.
    """
    mine = set(paths(records.schema))
    rows = records.withColumn("layout_hash", fingerprint(records.schema, mappings))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed([m for m in mappings if set(m.needs) <= mine]):
        fits = F.col("layout_hash").isin(*_layouts(m))
        name, turns = F.when(fits, F.lit(m.name)).otherwise(name), F.when(fits, _turns(m, mine)).otherwise(turns)
    return rows.withColumn("layout", name).withColumn("turns", turns)


def escaped(text: Column) -> Column:
    """Text without the control marker: each <| (and <\\|, ...) gets one more backslash between."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_escaped(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def rendered(turns: Column) -> Column:
    """Struct (formatted, loss) of turns: the text, and the spans [start, end) of characters that the loss counts."""
    blocks = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), _role_escaped(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, b: Column) -> Column:
        begin = state["at"] + F.length(b["head"])
        end = begin + F.length(b["body"])
        span = F.when(b["learn"], F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(END)).alias("at"), F.concat(state["spans"], span).alias("spans"))

    text = F.array_join(F.transform(blocks, lambda b: F.concat(b["head"], b["body"], F.lit(END))), "")
    return F.struct(text.alias("formatted"), F.aggregate(blocks, start, step, lambda s: s["spans"]).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(whole, lambda x: F.struct(_role_unescaped(F.substring(F.substring_index(x, "\n", 1), F.lit(len(START) + 1), F.length(x))).alias("role"), unescaped(F.substring(x, F.instr(x, "\n") + 1, F.length(x))).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def message_records(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as records (conv_id, part, messages) of the message layout.

    A part has the turns of one range of numbers, so a very long conversation is spread. Turns go by
    turn (null first), then role and text; null roles and texts are empty; rows without a conv_id are
    one conversation. Repeated rows are repeated turns. An empty table gives no records.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    part = F.floor(F.col("turn") / PART).cast("long")
    return rows.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("messages"))


def formatted_records(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Records (conv_id, part and any layout's columns) as (conv_id, part, formatted, loss).

    Each record's fingerprint selects its mapping; one of a layout that no mapping takes has no turns.
    """
    turns = canonical(records, mappings).select("conv_id", "part", F.coalesce("turns", F.array().cast(TURNS)).alias("turns"))
    return turns.select("conv_id", "part", rendered(F.col("turns")).alias("out")).select("conv_id", "part", "out.formatted", "out.loss")


def formatted_parts(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as (conv_id, part, formatted, loss).

    A conversation's text is that of its parts in order. Roles stay as they are.
    """
    return formatted_records(message_records(rows), AS_IS)


def formatted_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, formatted, loss) of whole conversations; loss spans count from the start of each."""
    parts = formatted_parts(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "formatted", "loss"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["formatted"]), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate("parts", start, lambda s, p: F.struct((s["at"] + F.length(p["formatted"])).alias("at"), F.concat(s["spans"], F.transform(p["loss"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["end"] + s["at"]).alias("end")))).alias("spans")), lambda s: s["spans"])
    return parts.select("conv_id", text.alias("formatted"), spans.alias("loss"))


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation what its formatted parts hold when read back: counts and SHA-256 of turns and of the loss text."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = parts.select("conv_id", "part", F.size(turns).cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"), said.alias("said"), masked(F.col("formatted"), F.col("loss")).alias("learnt"))
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("part", "said", "learnt"))).alias("parts"))
    said, learnt = F.array_join(F.transform("parts", lambda p: p["said"]), ""), F.array_join(F.transform("parts", lambda p: p["learnt"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
