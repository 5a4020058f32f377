"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths, mapped to canonical turns, and written under one template.

Only built-in expressions. A layout is a set of field paths with a declarative mapping (SQL expressions); a table's fingerprint is the SHA-256 of its
sorted paths, restricted to those some layout names, so other columns don't matter. Conversations stored as JSON of mixed layouts are told apart row by
row, by the fingerprint of each value's own paths; nulls and empty lists stand for any type. Of several layouts that fit, the one that has all paths of the
others is taken; if none has (messages beside a prompt and its completion, say), it isn't known what was meant. Such values, those of no layout, and what
isn't JSON are in `unmatched_json`; a table like that is refused.

Turns are shuffled once, by conversation. Texts and roles are escaped so that none of the template's control strings can occur in them: backslashes are
doubled, and a backslash is put behind the first character of each control string; reading reverses that.

Null text or role: empty. Ties of turn are ordered by role, then text; repeated rows are turns of their own; rows whose conv_id is null form one
conversation. A conversation without messages (a null or empty list) has no turns, and so no rows. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import table

#: The template's marks.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What must not occur in a text: <s> </s> [INST] [/INST] <<SYS>> <</SYS>> and <|any_name|>, found by first character and rest.
CONTROL_HEAD, CONTROL_REST = "[<\\[]", "/?s>|/?INST\\]|</?SYS>>|\\|[A-Za-z0-9_]+\\|>"


@dataclass(frozen=True)
class Layout:
    """paths: nested fields, `[]` for elements. Either rows are turns (by, order, role, text), or `turns` gives an array of (role, text)."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None


def _messages(array: str, role: str, text: str) -> str:
    return f"transform({array}, m -> named_struct('role', m.{role}, 'text', m.{text}))"


def _pair(prompt: str, answer: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {prompt}), named_struct('role', 'assistant', 'text', {answer}))"


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn")),
    Layout("messages", ("messages[].content", "messages[].role"), _messages("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")),
    Layout("instruction_input", ("input", "instruction", "output"), _pair("concat_ws('\\n\\n', nullif(instruction, ''), nullif(input, ''))", "output")),
    Layout("instruction", ("instruction", "output"), _pair("instruction", "output")),
    Layout("prompt_completion", ("completion", "prompt"), _pair("prompt", "completion")),
    Layout("prompt_response", ("prompt", "response"), _pair("prompt", "response")),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(kind: DataType, path: str = "") -> list[str]:
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return field_paths(kind.elementType, path + "[]") if isinstance(kind, ArrayType) else [path]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def layout_of(schema: StructType, layouts=LAYOUTS) -> Layout:
    """The layout whose fingerprint the schema has, restricted to the layout's paths, and that has all paths of others like that."""
    paths, known = set(field_paths(schema)), {fingerprint(x.paths): x for x in layouts}
    found = [known[f] for x in layouts if (f := fingerprint(paths & set(x.paths))) in known]
    if not found:
        raise ValueError(f"no layout has the fields {sorted(paths)}")
    whole = [x for x in found if all(set(y.paths) <= set(x.paths) for y in found)]
    if not whole:
        raise ValueError(f"several layouts have the fields {sorted(paths)}: {', '.join(x.name for x in found)}")
    return whole[0]


TURNS = "conv_id long, turn long, role string, text string"


def _turns(conv_id: Column, turns: Column, df: DataFrame) -> DataFrame:
    rows = df.select(conv_id.cast("long").alias("conv_id"), F.posexplode(turns).alias("turn", "t"))
    role = F.coalesce("t.role", F.lit(""))
    renamed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), role), role)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), renamed.alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def canonical(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """conv_id, turn, role and text of each turn, whatever known layout df has. Conversations in one row each need a conv_id, too."""
    layout = layout_of(df.schema, layouts)
    if layout.turns is None:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return _turns(F.col("conv_id"), F.expr(layout.turns), df)


def _parsed(df: DataFrame, column: str, layouts) -> DataFrame:
    """conv_id and value, with the name of the value's layout (or null) and its turns."""
    known = [x for x in layouts if x.turns]
    roots = sorted({p.split("[]")[0] for x in known for p in x.paths})
    fields = {r: sorted({p.split("[].")[1] for x in known for p in x.paths if p.startswith(r + "[].")}) for r in roots}
    kind = lambda v, at: f"schema_of_variant(variant_get({v}, '$.{at}'))"

    def there(path: str) -> Column:
        """The path itself, if the value has it: a text (or null), or in a list of objects (or nulls) texts (or nulls) wherever it is, and somewhere it is."""
        root, _, leaf = path.partition("[].")
        if not leaf:
            return F.when(F.expr(f"{kind('__v', root)} IN ('STRING', 'VOID')"), path)
        each = f"try_variant_get(__v, '$.{root}', 'array<variant>')"
        of = kind("e", leaf)
        fits = f"e IS NULL OR schema_of_variant(e) = 'VOID' OR (schema_of_variant(e) LIKE 'OBJECT%' AND ({of} IS NULL OR {of} IN ('STRING', 'VOID')))"
        some = f"exists({each}, e -> {of} IS NOT NULL) OR forall({each}, e -> e IS NULL OR schema_of_variant(e) = 'VOID')"
        return F.when(F.expr(f"forall({each}, e -> {fits}) AND ({some})"), path)

    v = df.select("conv_id", F.col(column).alias("value"), F.expr(f"try_parse_json(`{column}`)").alias("__v"))
    v = v.withColumn("__paths", F.array_compact(F.array(*[there(p) for p in sorted({p for x in known for p in x.paths})])))
    own = lambda x: F.array_sort(F.array_intersect("__paths", F.array(*[F.lit(p) for p in x.paths])))
    v = v.withColumns({f"__is_{x.name}": F.sha2(F.array_join(own(x), "\n"), 256) == fingerprint(x.paths) for x in known})
    layout = F.lit(None).cast("string")
    for x in known:
        beside = [F.col(f"__is_{y.name}") for y in known if not set(y.paths) <= set(x.paths)]
        within = [F.col(f"__is_{y.name}") for y in known if set(x.paths) < set(y.paths)]
        layout = F.when(F.col(f"__is_{x.name}") & ~functools.reduce(lambda a, b: a | b, [*beside, *within], F.lit(False)), x.name).otherwise(layout)
    typed = {r: "array<struct<" + ",".join(f"`{f}`:string" for f in fs) + ">>" if fs else "string" for r, fs in fields.items()}
    v = v.select("conv_id", "value", layout.alias("layout"), *[F.expr(f"try_variant_get(__v, '$.{r}', '{t}')").alias(r) for r, t in typed.items()])
    turns = F.lit(None)
    for x in known:
        turns = F.when(F.col("layout") == x.name, F.expr(x.turns)).otherwise(turns)
    return v.select("conv_id", "value", "layout", turns.alias("turns"))


def canonical_json(df: DataFrame, column: str = "value", layouts=LAYOUTS) -> DataFrame:
    """The same for conversations (conv_id, JSON value) of mixed layouts; see unmatched_json for the rest."""
    return _turns(F.col("conv_id"), F.col("turns"), _parsed(df, column, layouts))


def unmatched_json(df: DataFrame, column: str = "value", layouts=LAYOUTS) -> DataFrame:
    """conv_id and value of what canonical_json can't read."""
    return _parsed(df, column, layouts).where("layout IS NULL").select("conv_id", "value")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({CONTROL_HEAD})(?={CONTROL_REST})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, and loss_spans (start and length in code points): the escaped texts of the roles to learn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.select("conv_id", "turn", "role", "text", escaped(F.col("role")).alias("r"), escaped(F.col("text")).alias("x"))
    rows = rows.withColumn("shown", F.concat(F.lit(START), "r", F.lit(SEP), "x", F.lit(END)))
    rows = rows.withColumns({"nth": F.row_number().over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "to": F.sum(F.length("shown").cast("long")).over(order)})
    span = F.when(F.col("role").isin(*learn), F.struct((F.col("to") - len(END) - F.length("x")).alias("start"), F.length("x").cast("long").alias("length")))
    parts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "shown", span.alias("span")))).alias("parts"))
    return parts.select(
        "conv_id", F.size("parts").cast("long").alias("n_turns"), F.array_join("parts.shown", "").alias("formatted"), F.filter("parts.span", lambda s: s.isNotNull()).alias("loss_spans")
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text) and learned (texts under the loss mask), read back from format_chats' output."""
    pieces = F.filter(F.split("formatted", END.replace("|", "\\|")), lambda x: x != "")
    sides = F.transform(pieces, lambda x: F.split(F.substring(x, len(START) + 1, 2147483647), SEP.replace("|", "\\|")))
    turns = F.transform(sides, lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text")))
    learned = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), learned.alias("learned"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations (rows by turn), and one whose texts are control strings (a row with messages)."""
    said = F.struct(F.lit("user").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("content"))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(*said).alias("messages"))
    turns = canonical(table(spark, sf_dir, "conversations")).unionByName(canonical(extra))
    shown = format_chats(turns)
    back = read_chats(shown.withColumn("conv_id", F.struct("conv_id", "formatted")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return back.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("conv_id.formatted").cast("long").alias("formatted_chars"),
    )


_SQL_CONTROL = f"{CONTROL_HEAD}({CONTROL_REST})"
SQL_OP5 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, role || chr(10) || text || chr(10) AS line, role || text AS both_sides,
    length(role) + length(text) + length(regexp_replace(role || text, '[^\\\\]', '', 'g')) AS doubled,
    len(regexp_extract_all(replace(role, '\\', '\\\\'), '{_SQL_CONTROL}')) + len(regexp_extract_all(replace(text, '\\', '\\\\'), '{_SQL_CONTROL}')) AS marks FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(line, '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(doubled + marks + {len(START + SEP + END)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

QUERIES = {"op5_chat_formatting": op5_chat_formatting}
SQL = {"op5_chat_formatting": SQL_OP5}
