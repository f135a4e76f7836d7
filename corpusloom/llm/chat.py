"""Chat formatting: records of many layouts become turns, and turns become one text with a loss mask.

A record is a struct of nullable fields, as Spark reads them from JSON.  Its fingerprint is a hash of the nested field paths that have a value in
it.  A layout declares the paths that it needs, those that it may have and how its turns come from them; the fingerprints that it accepts follow
from the declaration, so a record finds its layout by one comparison of hashes.  Everything is built-in functions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import load

TURNS = "array<struct<role:string,text:string>>"

# --- layouts


@dataclass(frozen=True)
class Say:
    """One turn of a role: the fields that are there, joined by a blank line; no turn where none is."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each struct of an array; ``names`` maps its role names to the canonical ones, others stay."""

    path: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Pairs:
    """Two turns, user and assistant, for each inner array."""

    path: str


@dataclass(frozen=True)
class Layout:
    """How records with these field paths are turns; [] marks what is in an array."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[Say | Each | Pairs, ...]

    def path_sets(self) -> list[tuple[str, ...]]:
        return [tuple(sorted({*self.needs, *some})) for k in range(len(self.may) + 1) for some in combinations(self.may, k)]


_SYSTEM = Say("system", ("system",))
#: Where two layouts accept the same paths, the first is taken.
LAYOUTS = (
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content", "system"), (_SYSTEM, Each("messages", "role", "content"))),
    Layout("speakers", ("conversations[]",), ("conversations[].from", "conversations[].value", "system"), (_SYSTEM, Each("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))))),
    Layout("instruction", ("instruction",), ("input", "output", "system", "history[][]"), (_SYSTEM, Pairs("history"), Say("user", ("instruction", "input")), Say("assistant", ("output",)))),
    Layout("prompt_response", ("prompt",), ("response", "system", "history[][]"), (_SYSTEM, Pairs("history"), Say("user", ("prompt",)), Say("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt",), ("completion", "system"), (_SYSTEM, Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Layout("preference", ("prompt", "chosen"), ("rejected", "system"), (_SYSTEM, Say("user", ("prompt",)), Say("assistant", ("chosen",)))),
    Layout("question", ("question",), ("context", "answer", "system"), (_SYSTEM, Say("user", ("context", "question")), Say("assistant", ("answer",)))),
)


def _hash(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def _fields(kind: T.DataType, at: Column, path: str) -> list[tuple[str, Column]]:
    """(path, whether it has a value) of what is in a value of a type; a null array has nothing, an empty one has its own path."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _fields(f.dataType, at.getField(f.name), f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StructType):
            within = [(f"{path}[].{f.name}", _some(at, f.name)) for f in inner.fields]
            return [(f"{path}[]", at.isNotNull()), *within]
        return [(path + "[]" * _depth(kind), at.isNotNull())]
    return [(path, at.isNotNull())]


def _some(array: Column, name: str) -> Column:
    return F.exists(array, lambda x: x.getField(name).isNotNull())


def _depth(kind: T.DataType) -> int:
    return 1 + _depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def fingerprint(record: Column, schema: T.StructType, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """The hash of a record's nested field paths.  Only paths that some layout speaks of count, so ids, scores and the like don't matter."""
    known = {p for x in layouts for p in (*x.needs, *x.may)}
    found = sorted((p, has) for p, has in _fields(schema, record, "") if p in known) if known else []
    return F.sha2(F.concat_ws("\n", *(F.when(has, F.lit(p)) for p, has in sorted(found, key=lambda x: x[0]))), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(record: Column, fields: set[str], spec: Say | Each | Pairs, schema: T.StructType) -> Column | None:
    """What a part of a layout gives; None where the record's type has none of its fields."""
    if isinstance(spec, Say):
        own = [record.getField(p).cast("string") for p in spec.paths if p in fields]
        text = F.concat_ws("\n\n", *(F.when(c != "", c) for c in own))
        return F.when(F.coalesce(*own).isNotNull(), F.array(_turn(F.lit(spec.role), text))).otherwise(F.array().cast(TURNS)) if own else None
    kind = schema[spec.path].dataType if spec.path in fields else None
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.ArrayType if isinstance(spec, Pairs) else T.StructType):
        return None
    rows = record.getField(spec.path)
    if isinstance(spec, Pairs):
        pair = lambda x: F.array(_turn(F.lit("user"), F.get(x, F.lit(0))), _turn(F.lit("assistant"), F.get(x, F.lit(1))))
        return F.coalesce(F.flatten(F.transform(rows, pair)), F.array().cast(TURNS))
    inner = kind.elementType.names
    none = F.lit(None).cast("string")

    def one(x: Column) -> Column:
        role = x.getField(spec.role) if spec.role in inner else none
        named = F.when(role == spec.names[0][0], spec.names[0][1]) if spec.names else None
        for old, new in spec.names[1:]:
            named = named.when(role == old, new)
        return _turn(named.otherwise(role) if spec.names else role, x.getField(spec.text) if spec.text in inner else none)

    return F.coalesce(F.transform(rows, one), F.array().cast(TURNS))


def canonical(record: Column, print_: Column, schema: T.StructType, layouts: Sequence[Layout] = LAYOUTS) -> tuple[Column, Column]:
    """(layout, turns) of a record by its fingerprint; null where no layout accepts it.  A null role or text is empty."""
    fields = set(schema.names)
    taken: set[str] = set()
    name = turns = None
    for x in layouts:
        prints = [h for s in x.path_sets() if (h := _hash(s)) not in taken]
        taken |= set(prints)
        parts = [t for spec in x.turns if (t := _turns(record, fields, spec, schema)) is not None]
        if not parts or not {re.split(r"[.\[]", p)[0] for p in x.needs} <= fields:
            continue
        ours = print_.isin(prints)
        name = F.when(ours, x.name) if name is None else name.when(ours, x.name)
        turns = F.when(ours, F.concat(*parts)) if turns is None else turns.when(ours, F.concat(*parts))
    return (F.lit(None).cast("string"), F.lit(None).cast(TURNS)) if name is None else (name, turns)


# --- template

# Marks of chat templates that texts must not contain as they are.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Template:
    """A turn is start, role, middle, text, end; each mark contains one of the controls.

    In roles and texts a backslash is doubled, and a control gets one after its first character.  What follows a backslash is then always what
    it stands for, so escaped texts contain no control and can be read back.
    """

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self) -> None:
        if any(len(c) < 2 or "\\" in c for c in self.controls) or not all(any(c in m for c in self.controls) for m in (self.start, self.middle, self.end)):
            raise ValueError("a control has two characters or more and no backslash, and each mark contains one")

    def escape(self, text: Column) -> Column:
        first = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), first, "$0\\\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column, template: Template) -> Column:
    one = lambda t: F.concat(F.lit(template.start), t["role"], F.lit(template.middle), t["text"], F.lit(template.end))
    return F.array_join(F.transform(turns, one), "")


def mask(turns: Column, template: Template, learned: Sequence[str]) -> Column:
    """(turn, start, end) of the text of each escaped turn of a learned role: characters from start up to end of what the turn is written as."""

    def span(t: Column, i: Column) -> Column:
        start = F.length(t["role"]) + len(template.start) + len(template.middle)
        return F.struct(i.alias("turn"), start.alias("start"), (start + F.length(t["text"])).alias("end"), t["role"].isin(*learned).alias("on"))

    on = F.filter(F.transform(turns, span), lambda s: s["on"])
    return F.transform(on, lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["end"].alias("end")))


def written_turns(formatted: Column, template: Template) -> Column:
    """What each turn is written as, without its end mark."""
    parts = F.split(formatted, re.escape(template.end))
    return F.slice(parts, 1, F.size(parts) - 1)


def read_turns(written: Column, template: Template) -> Column:
    """(role, text) read back from written turns."""

    def one(w: Column) -> Column:
        halves = F.split(w, re.escape(template.middle))
        return F.struct(template.unescape(F.substring(halves[0], len(template.start) + 1, 1 << 30)).alias("role"), template.unescape(halves[1]).alias("text"))

    return F.transform(written, one)


def read_masked(written: Column, loss: Column, template: Template) -> Column:
    """The text under the mask, unescaped."""
    cut = lambda s: template.unescape(F.substr(F.get(written, s["turn"]), s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(loss, cut), "")


def format_chats(records: DataFrame, record: str = "record", template: Template | None = None, layouts: Sequence[Layout] = LAYOUTS, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """``records`` without the record but with fingerprint, layout, formatted and loss.

    ``loss`` has the spans to learn from, by turn (see ``mask``), so it grows with the turns and is read in one pass.  A record whose paths no
    layout accepts keeps its row, with its fingerprint and nulls; so does a null record.  Columns of the four names are replaced.  A null role or
    text is empty, texts are of any length, repeated rows are formatted each.  A conversation is one value, so one task holds it.
    """
    template = template or Template()
    schema = records.schema[record].dataType
    others = [F.col(f"`{c}`") for c in records.columns if c not in (record, "fingerprint", "layout", "formatted", "loss")]
    seen = records.select(*others, F.col(record).alias("__r"), fingerprint(F.col(record), schema, layouts).alias("fingerprint"))
    layout, turns = canonical(F.col("__r"), F.col("fingerprint"), schema, layouts)
    told = seen.select(*others, "fingerprint", layout.alias("layout"), turns.alias("__turns"))
    safe = lambda t: F.struct(template.escape(t["role"]).alias("role"), template.escape(t["text"]).alias("text"))
    told = told.withColumn("__turns", F.transform("__turns", safe))
    return told.select(*others, "fingerprint", "layout", render(F.col("__turns"), template).alias("formatted"), mask(F.col("__turns"), template, learned).alias("loss"))


def gathered(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): each conversation's rows in order, ties by role and text; nulls first, empty in what is gathered."""
    whole = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))))
    return rows.groupBy(F.col(key).alias(key)).agg(whole.alias("turns"))


PROBE = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations are put into the layouts that such data come in, by their shape, and formatted from there."""
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = load(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    turns = F.col("turns")
    pair = (F.size(turns) == 2) & (turns[0]["role"] == "user") & (F.get(turns, F.lit(1))["role"] == "assistant")
    plain = F.forall(turns, lambda t: t["role"].isin("user", "assistant", "system"))
    third = F.coalesce(F.pmod("conv_id", F.lit(3)), F.lit(2))
    kind = F.when(pair & (third == 0), "prompt").when(pair & (third == 1), "instruction").when(plain & (third != 2), "speakers").otherwise("messages")
    speaker = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    of: Mapping[str, tuple[str, Callable[[], Column]]] = {
        "messages": ("messages", lambda: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))),
        "conversations": ("speakers", lambda: F.transform(turns, lambda t: F.struct(speaker(t["role"]).alias("from"), t["text"].alias("value")))),
        "prompt": ("prompt", lambda: turns[0]["text"]), "response": ("prompt", lambda: F.get(turns, F.lit(1))["text"]),
        "instruction": ("instruction", lambda: turns[0]["text"]), "output": ("instruction", lambda: F.get(turns, F.lit(1))["text"]),
    }
    records = gathered(rows).withColumn("kind", kind).select("conv_id", F.struct(*(F.when(F.col("kind") == k, c()).alias(f) for f, (k, c) in of.items())).alias("record"))
    template = Template()
    out = format_chats(records, template=template).withColumn("written", written_turns(F.col("formatted"), template))
    back = out.select("conv_id", read_turns(F.col("written"), template).alias("turns"), read_masked(F.col("written"), F.col("loss"), template).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_MARKS = len(Template.start + Template.middle + Template.end)
OP11_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
  sum({_MARKS} + length({_escaped_sql('role')}) + length({_escaped_sql('text')}))::BIGINT AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
"""
