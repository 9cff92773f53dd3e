"""Chat formatting by schema fingerprints, with DataFrame operations only.

A fingerprint is the hash of a layout's sorted nested field paths; it selects the declarative mapping that turns the layout
into canonical turns (conv_id, turn, role, text). Tables are read by the fingerprint of their schema and keep the type of conv_id; JSON
records are fingerprinted one by one, over all elements of their arrays, and each is mapped by its own. Their conv_id is a
string as written, so that ids of any kind stay apart. Turns are then set in a template whose control strings are
escaped, reversibly, where they occur inside roles and texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What a template or tokenizer may take for control: (opening bracket)(the rest).
_CONTROL = r"([<\[])(~*)(/?s>|/?INST\]|\|im_start\|>|\|im_end\|>)"
_ESCAPED = r"([<\[])~(~*)(/?s>|/?INST\]|\|im_start\|>|\|im_end\|>)"


def escape(text: Column) -> Column:
    """A tilde goes after the bracket of each control string, and one more where there are some: no control string is left."""
    return F.regexp_replace(text, _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role ends at its line's end, so its own line feeds and backslashes are written as \\n and \\\\."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


# --- layouts ----------------------------------------------------------------------------------------------------------


def paths(schema: T.DataType, at: str = "") -> list[str]:
    """The field paths of a schema; [] stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths(f.dataType, f"{at}.{f.name}".lstrip("."))]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, at + "[]")
    return [at]


def fingerprint(of: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(of)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Field paths of a layout and its turns: an array expression of (role, text), or the columns of a table of turns."""

    fields: tuple[str, ...]
    turns: str | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(list(self.fields))


_PAIR = "array(named_struct('role', 'user', 'text', {0}), named_struct('role', 'assistant', 'text', {1}))"
MAPPINGS = (
    Mapping(("conv_id", "turn", "role", "text")),
    Mapping(("conv_id", "messages[].role", "messages[].content"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Mapping(("conv_id", "conversations[].from", "conversations[].value"), "transform(conversations, m -> named_struct('role', case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end, 'text', m.value))"),
    Mapping(("conv_id", "prompt", "completion"), _PAIR.format("prompt", "completion")),
    Mapping(("conv_id", "prompt", "response"), _PAIR.format("prompt", "response")),
    Mapping(("conv_id", "instruction", "output"), _PAIR.format("instruction", "output")),
    Mapping(("conv_id", "instruction", "input", "output"), _PAIR.format("concat_ws('\\n\\n', instruction, nullif(input, ''))", "output")),
    Mapping(("conv_id", "question", "answer"), _PAIR.format("question", "answer")),
)
BY_FINGERPRINT = {m.fingerprint: m for m in MAPPINGS}
#: The arrays that mappings name, with the paths that they name below them.
ARRAYS = {k: sorted({f for m in MAPPINGS for f in m.fields if f.startswith(f"{k}[].")}) for k in sorted({f.split("[]")[0] for m in MAPPINGS for f in m.fields if "[]" in f})}
#: The columns that a JSON record of any mapped layout may have.
RECORD = "conv_id string, turn bigint, role string, text string, messages array<struct<role string, content string>>, conversations array<struct<`from` string, value string>>, prompt string, completion string, response string, instruction string, input string, output string, question string, answer string"


def _turns(df: DataFrame, expression: str) -> DataFrame:
    at = df.select("conv_id", F.posexplode(F.expr(expression)).alias("turn", "m"))
    return at.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").cast("string").alias("role"), F.col("m.text").cast("string").alias("text"))


def canonical_turns(df: DataFrame) -> DataFrame:
    """The turns of a table, whose layout is found by the fingerprint of its schema; columns besides the layout's are let go.

    Raises ValueError where no mapping's fields are all there. If several fit, the exact fingerprint wins, then the mapping of most fields.
    """
    own = paths(df.schema)
    mapping = BY_FINGERPRINT.get(fingerprint(own)) or max((m for m in MAPPINGS if set(m.fields) <= set(own)), key=lambda m: len(m.fields), default=None)
    if mapping is None:
        raise ValueError(f"no mapping for the fields {sorted(own)}")
    if mapping.turns:
        return _turns(df, mapping.turns)
    return df.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def record_paths(record: Column) -> Column:
    """A JSON record's field paths in order, of objects in arrays too (to the depth that MAPPINGS need: two); null if it is no object.

    An array has the paths of all its elements, and one that MAPPINGS name has the paths named there when it is empty.
    """
    at = lambda k, more: F.call_function("get_json_object", record, F.concat(F.lit("$['"), k, F.lit("']" + more)))
    objects = lambda k: F.array_compact(F.transform(F.from_json(at(k, ""), "array<string>", {"maxStringLen": "2147483647"}), F.json_object_keys))
    inner = lambda k: F.transform(F.array_distinct(F.flatten(objects(k))), lambda x: F.concat(k, F.lit("[]."), x))
    named = F.create_map(*[c for k, fields in ARRAYS.items() for c in (F.lit(k), F.array(*map(F.lit, fields)))])
    none = lambda k: k.isin([*ARRAYS]) & F.equal_null(at(k, ""), F.lit("[]"))
    below = lambda k: F.when(at(k, "[*]").isNotNull(), inner(k)).when(none(k), named[k])
    each = lambda k: F.coalesce(F.nullif(below(k), F.array().cast("array<string>")), F.array(k))
    return F.array_sort(F.flatten(F.transform(F.json_object_keys(record), each)))


def _layout(record: Column, own: Column) -> Column:
    """The fingerprint of the mapping for a record with the paths ``own``: that of just these, else that of most fields which are all there.

    Null if there is none, and for a whole conversation whose conv_id is null: it would be mixed with others.
    """
    exact = F.sha2(F.array_join(own, "\n"), 256)
    choice = F.lit(None).cast("string")
    for m in sorted(MAPPINGS, key=lambda m: len(m.fields)):
        choice = F.when(F.size(F.array_except(F.array(*map(F.lit, m.fields)), own)) == 0, m.fingerprint).otherwise(choice)
    choice = F.when(exact.isin([*BY_FINGERPRINT]), exact).otherwise(choice)
    rows = [m.fingerprint for m in MAPPINGS if not m.turns]
    return F.when(choice.isin(rows) | F.get_json_object(record, "$.conv_id").isNotNull(), choice)


def _once(column: Column) -> Column:
    """The column as a generated one: later filters on it stay above, and so don't compute it again for each time they name it."""
    return F.explode(F.array(column))


def _read(df: DataFrame, record_col: str) -> DataFrame:
    record = df.select(F.col(record_col).alias("record"))
    return record.withColumn("own", _once(record_paths(F.col("record")))).withColumn("layout", _once(_layout(F.col("record"), F.col("own")))).select("record", "layout")


def unmapped_records(df: DataFrame, record_col: str) -> DataFrame:
    """(record) of the JSON records that canonical_records() has no mapping for, of whole conversations without a conv_id, and of what is no JSON object."""
    return _read(df, record_col).where("layout is null").select("record")


def _mapped(df: DataFrame, record_col: str) -> DataFrame:
    """(conv_id string, turns array of (turn, role, text)) of the records that have a mapping."""
    each = "transform({0}, (m, k) -> named_struct('turn', cast(k as bigint), 'role', cast(m.role as string), 'text', cast(m.text as string)))"
    choice = F.lit(None).cast("array<struct<turn bigint, role string, text string>>")
    for m in MAPPINGS:
        turns = each.format(m.turns) if m.turns else "array(named_struct('turn', turn, 'role', role, 'text', text))"
        choice = F.when(F.col("layout") == m.fingerprint, F.expr(turns)).otherwise(choice)
    read = _read(df, record_col).where("layout is not null").select("layout", _once(F.from_json("record", RECORD, {"maxStringLen": "2147483647"})).alias("r")).select("layout", "r.*")
    return read.select("conv_id", _once(choice).alias("turns"))


def canonical_records(df: DataFrame, record_col: str, keep_empty: bool = False) -> DataFrame:
    """The turns of JSON records in mixed layouts, each mapped by its own fingerprint; see unmapped_records() for those of none.

    conv_id is a string, and records of one conv_id are one conversation. A record of one turn has its own number of turn; others
    count from 0. A message without a field of its layout has null there. Fields besides a layout's are let go. A record whose
    array of messages is empty has no turns; with ``keep_empty`` it has one row with true in a further column ``empty``, by
    which format_chats() keeps a conversation of no turns.
    """
    mapped = _mapped(df, record_col)
    if not keep_empty:
        return mapped.select("conv_id", F.explode("turns").alias("m")).select("conv_id", "m.turn", "m.role", "m.text")
    return mapped.select("conv_id", F.posexplode_outer("turns").alias("k", "m")).select("conv_id", "m.turn", "m.role", "m.text", F.col("k").isNull().alias("empty"))


# --- template ---------------------------------------------------------------------------------------------------------


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of each conversation: mask is the runs (length in code points, loss) that make up ``formatted``.

    Null roles and texts are empty. Turns are ordered by turn, then role, then text (nulls first); repeated ones stay. Only assistant
    texts are under the loss. A conversation is one text, so its turns meet in one row; conversations spread freely. A row
    with true in a column ``empty`` is no turn; a conversation of such rows alone has an empty text and no runs.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    none = F.coalesce("empty", F.lit(False)) if "empty" in turns.columns else F.lit(False)
    x = turns.select(none.alias("none"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.select("none", "conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    row = F.struct(F.col("turn"), F.col("role"), F.col("text"), F.col("head"), F.col("body"))
    each = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(~F.col("none"), row))).alias("rows"))
    end = CLOSE + "\n"
    formatted = F.array_join(F.transform("rows", lambda r: F.concat(r.head, r.body, F.lit(end))), "")
    run = lambda n, loss: F.struct(n.cast("int").alias("length"), loss.alias("loss"))
    mask = F.flatten(F.transform("rows", lambda r: F.array(run(F.length(r.head), F.lit(False)), run(F.length(r.body), r.role == "assistant"), run(F.lit(len(end)), F.lit(False)))))
    return each.select("conv_id", formatted.alias("formatted"), mask.alias("mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array of (role, text), losses array of text) read back from ``formatted`` and ``mask`` alone, row by row."""
    piece = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    turn = lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n", ""), r"<\|im_end\|>\n\z", "")).alias("text"))
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start int, length int>>").alias("spans"))
    step = lambda so, run: F.struct((so.at + run.length).alias("at"), F.when(run.loss, F.array_append(so.spans, F.struct(so.at.alias("start"), run.length.alias("length")))).otherwise(so.spans).alias("spans"))
    spans = F.aggregate("mask", none, step).spans
    cut = F.transform(spans, lambda s: unescape(F.substring(F.col("formatted"), s.start, s.length)))
    return formatted.select("conv_id", "formatted", F.transform(piece, turn).alias("turns"), cut.alias("losses"))
