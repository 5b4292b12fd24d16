"""Chat formatting by schema fingerprints, in DataFrame operations only.

Layouts of prompt, instruction, message and turn data are declared as mappings: field paths and an expression that gives
an array of (role, text) turns. The fingerprint of a layout is the XXH64 of its sorted nested field paths. A
table's schema, or the fields that are present in each record of a JSON column (NULL values too), is reduced to the
paths that a mapping knows; if the hash of those is one that the mapping is registered under, the mapping is selected.
Mappings go in order of declaration and the first that fits is taken; fields that it does not know do not matter.

Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash becomes
``\\b`` and ``<|`` becomes ``<\\p``, and in roles a line break becomes ``\\n``: no text can hold a control string, and
plain replacement in the reverse order gives the text back. The loss mask is the spans of the assistant's texts.

Edge cases: a NULL role or text is empty; rows of a conversation go by turn (NULL first), then role, then text;
repeated rows are repeated turns; rows with a NULL conv_id are one conversation with that id; an empty table
gives none; columns that clash with an output's name are replaced. A JSON record with an empty array of messages has no
turns; field names of JSON records are compared as they are. A record that no mapping fits, as one that is not a JSON
object, has a NULL layout and no turns, and ``rejects`` counts such records by their field paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tessel.llm.shared import fresh

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
_ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


# Layouts


def paths(schema: DataType, prefix: str = "") -> list[str]:
    """Nested field paths of the leaves, lower-cased; ``[]`` marks the elements of an array."""
    if isinstance(schema, StructType):
        return [p for f in schema for p in paths(f.dataType, f"{prefix}.{f.name.lower()}" if prefix else f.name.lower())]
    if isinstance(schema, ArrayType):
        return paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(names: Iterable[str]) -> int:
    """What Spark's xxhash64 gives for the sorted paths, joined by a space."""
    h = xxhash.xxh64_intdigest(" ".join(sorted(names)).encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def _role(c: Column) -> Column:
    c = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(c == "", F.lit(""))
    for alias, role in _ROLES.items():
        out = out.when(c == alias, F.lit(role))
    return out.otherwise(c)


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _messages(array: str, role: str, text: str) -> Callable[[Column | None], Column]:
    return lambda get: F.transform(get(array), lambda m: F.struct(_role(m[role]).alias("role"), F.coalesce(m[text].cast("string"), F.lit("")).alias("text")))


@dataclass(frozen=True)
class Mapping:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column]


def _prompt(answer: str):
    def turns(get):
        return F.filter(F.array(F.when(get("system").isNotNull(), _turn("system", get("system"))), _turn("user", get("prompt")), _turn(TRAINED, get(answer))), lambda t: t.isNotNull())

    return turns


def _instruction(get):
    extra = F.coalesce(get("input"), F.lit(""))
    asked = F.when(extra == "", F.coalesce(get("instruction"), F.lit(""))).otherwise(F.concat_ws("\n\n", get("instruction"), extra))
    return F.filter(F.array(F.when(get("system").isNotNull(), _turn("system", get("system"))), _turn("user", asked), _turn(TRAINED, get("output"))), lambda t: t.isNotNull())


def _verbatim(get):
    return F.transform(get("turns"), lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")))


MAPPINGS = [
    Mapping("turns", ("turns[].role", "turns[].text"), (), _verbatim),
    Mapping("messages", ("messages[].content", "messages[].role"), (), _messages("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), (), _messages("conversations", "from", "value")),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), _instruction),
    Mapping("prompt-completion", ("completion", "prompt"), ("system",), _prompt("completion")),
    Mapping("prompt-response", ("prompt", "response"), ("system",), _prompt("response")),
]
#: Elements are read as maps, which tell a field that is NULL from one that is absent.
ARRAYS = ("turns", "messages", "conversations")
SCALARS = ("instruction", "input", "output", "system", "prompt", "completion", "response")
JSON_SCHEMA = ", ".join([*(f"{a} array<map<string, string>>" for a in ARRAYS), *(f"{s} string" for s in SCALARS)])
_JSON_OPTIONS = {"maxStringLen": str(2**31 - 1)}


def registry(m: Mapping) -> list[int]:
    """The fingerprints that select a mapping: its required paths with each choice of the optional ones, and an
    empty array where it reads one."""
    out = [fingerprint((*m.required, *more)) for n in range(len(m.optional) + 1) for more in combinations(m.optional, n)]
    top = m.required[0].partition("[]")[0]
    return [*out, fingerprint((f"{top}[]",))] if top in ARRAYS else out


def known_to(m: Mapping) -> list[str]:
    top = m.required[0].partition("[]")[0]
    return [*m.required, *m.optional, *([f"{top}[]"] if top in ARRAYS else [])]


def turns_of_table(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with an array of (role, text) by the mapping that its schema selects."""
    have = paths(df.schema)
    mapping = next((m for m in MAPPINGS if fingerprint(set(have) & set(known_to(m))) in registry(m)), None)
    if mapping is None:
        raise ValueError(f"no mapping for the fields {', '.join(have) or '(none)'}")
    top = {c.lower(): c for c in df.columns}
    return df.withColumn(turns, mapping.turns(lambda name: F.col(f"`{top[name]}`") if name in top else F.lit(None).cast("string")))


def json_paths(raw: Column, parsed: Column) -> Column:
    """Sorted nested paths of the fields present in a JSON object, NULL or not; ``[]`` marks the elements of an array."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    nothing = F.array().cast("array<string>")

    def inside(a: str) -> Column:
        names = F.array_distinct(F.flatten(F.transform(parsed[a], lambda e: F.coalesce(F.map_keys(e), nothing))))
        found = F.when(F.size(names) == 0, F.array(F.lit(f"{a}[]"))).otherwise(F.transform(names, lambda k: F.concat(F.lit(f"{a}[]."), k)))
        return F.coalesce(found, nothing)

    flat = F.filter(keys, lambda k: ~F.coalesce(F.array_contains(F.array(*(F.when(parsed[a].isNotNull(), F.lit(a)) for a in ARRAYS)), k), F.lit(False)))
    return F.array_sort(F.array_distinct(F.concat(flat, *map(inside, ARRAYS))))


def turns_of_json(df: DataFrame, column: str, layout: str = "layout", turns: str = "turns", fields: str = "fields") -> DataFrame:
    """``df`` with the layout's name, the turns and the field paths of each record of a JSON column, whose records may
    differ in layout."""
    read, there = fresh(df, "record", "paths")
    rows = df.withColumn(read, F.from_json(F.col(column), JSON_SCHEMA, _JSON_OPTIONS))
    rows = rows.withColumn(there, json_paths(F.col(column), F.col(read)))
    name, out = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for m in reversed(MAPPINGS):  # so that the first that fits is asked first
        mark = F.xxhash64(F.array_join(F.array_intersect(there, F.array(*(F.lit(p) for p in sorted(known_to(m))))), " "))
        fits = mark.isin(registry(m))
        name = F.when(fits, F.lit(m.name)).otherwise(name)
        out = F.when(fits, m.turns(lambda n: F.col(f"`{read}`.`{n}`"))).otherwise(out)
    return rows.withColumns({layout: name, turns: out, fields: F.col(there)}).drop(read, *([there] if there != fields else []))


def rejects(read: DataFrame, layout: str = "layout", fields: str = "fields") -> DataFrame:
    """(fields, n): how many records of ``turns_of_json``'s result fit no mapping, by their field paths."""
    return read.where(F.col(layout).isNull()).groupBy(F.array_join(fields, " ").alias("fields")).agg(F.count("*").alias("n"))


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from (conv_id, turn, role, text) rows, which go by turn (NULL first), role and text: each conversation as a JSON record in the plainest layout
    that holds it: prompt and completion, with a system text before it or not, or else its turns."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    text = lambda i: F.get("t", F.lit(i))["text"]
    said = F.array_join(F.transform("t", lambda x: F.concat(F.length(x["role"]).cast("string"), x["role"])), "")
    as_json = lambda s: F.to_json(s, {"ignoreNullFields": "false"})
    short = F.struct(text(0).alias("prompt"), text(1).alias("completion"))
    system = F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion"))
    whole = F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return packed.select("conv_id", F.when(said == "4user9assistant", as_json(short)).when(said == "6system4user9assistant", as_json(system)).otherwise(as_json(whole)).alias("record"))


# Rendering


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from (conv_id, turn, role, text) rows.

    ``loss_spans``: 0-based [start, stop) code points of each assistant text in ``formatted``.
    One exchange: offsets are running sums in the same partitioning as the collection. A conversation is collected
    whole, since its text is one value of the result.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    r = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    r = r.withColumns({"head": head, "body": escape(F.col("text"))})
    r = r.withColumn("piece", F.concat("head", "body", F.lit(END)))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(w), F.lit(0)))
    start = F.col("at") + F.char_length("head")
    span = F.when(F.col("role") == TRAINED, F.struct(start.alias("start"), (start + F.char_length("body")).alias("stop")))
    all_turns = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", span.alias("span")))).alias("turns"))
    return all_turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def format_turns(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """``format_conversations`` of (conv_id, turns) rows, one for each conversation; those without turns are left out."""
    rows = conversations.select("conv_id", F.posexplode(turns).alias("turn", "said"))
    return format_conversations(rows.select("conv_id", "turn", "said.role", "said.text"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) parsed from a formatted conversation alone."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 2**31 - 2)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.char_length(head) + 2, F.char_length(p) - F.char_length(head) - 1 - len(END))
        return F.struct(unescape(head, role=True).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the output."""
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = formatted.withColumns({"turns": turns, "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
