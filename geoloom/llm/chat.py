"""Chat formatting: records of many layouts become canonical turns, turns become template text with a loss mask, and back.

A record's schema fingerprint is the hash of its nested field paths, as far as any layout knows them; it selects the layout's
declarative mapping. Typed tables have one fingerprint, JSON records one each. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Fields:
    """One turn per entry: a role, and the fields whose texts make it up, with a blank line between them."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        return [p for _, fields in self.turns for p in fields]

    def ddl(self) -> str:
        return ", ".join(f"`{p}` string" for p in self.paths())

    def convert(self, of) -> Column:
        """``of(name)`` is the column of a top field, or None where the record has no such field."""
        out = []
        for role, fields in self.turns:
            there = [c for c in (of(p) for p in fields) if c is not None]
            if there:
                text = F.array_join(F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in there]), lambda t: t != ""), "\n\n")
                turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
                # a field that may be missing makes no turn when it is null
                out.append(F.when(F.coalesce(*there).isNotNull(), turn) if set(fields) <= set(self.optional) else turn)
        return F.filter(F.array(*out), lambda t: t.isNotNull())


@dataclass(frozen=True)
class Messages:
    """A list of messages with a role and a text each; ``roles`` renames roles."""

    name: str
    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        return [self.path, f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"]

    def ddl(self) -> str:
        return f"`{self.path}` array<struct<`{self.role}` string, `{self.text}` string>>"

    def convert(self, of) -> Column:
        def turn(m: Column) -> Column:
            role = F.coalesce(m[self.role], F.lit(""))
            named = role
            for theirs, ours in self.roles:
                named = F.when(role == theirs, F.lit(ours)).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text"))
        return F.coalesce(F.transform(of(self.path), turn), F.array().cast(TURNS))


@dataclass(frozen=True)
class Rows:
    """One row a turn: rows of one id make a conversation, in the order of a column (null first), then by role and text."""

    name: str
    order: str
    role: str
    text: str
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        return [self.order, self.role, self.text]


LAYOUTS = (
    Fields("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Fields("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Fields("prompt_completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields("question_answer", (("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
    Messages("messages", "messages", "role", "content"),
    Messages("conversations", "conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    Rows("turn_rows", "turn", "role", "text"),
)
KNOWN = sorted({p for layout in LAYOUTS for p in layout.paths()})


def fingerprint(paths) -> str:
    """The hash of the field paths that any layout knows; others, their order and repeats don't count."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()[:16]


def _by_fingerprint() -> dict[str, tuple]:
    """Fingerprint to ``(layout, the paths it stands for)``, one for each choice of optional fields."""
    out: dict[str, tuple] = {}
    for layout in LAYOUTS:
        for k in range(len(layout.optional) + 1):
            for absent in itertools.combinations(layout.optional, k):
                paths = [p for p in layout.paths() if p not in absent]
                if out.setdefault(fingerprint(paths), (layout, paths))[0] is not layout:
                    raise ValueError(f"layouts {layout.name} and {out[fingerprint(paths)][0].name} have the same fields")
    return out


BY_FINGERPRINT = _by_fingerprint()


def schema_paths(schema: DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(schema, StructType):
        return [p for f in schema.fields for p in [prefix + f.name, *schema_paths(f.dataType, prefix + f.name + ".")]]
    if isinstance(schema, ArrayType):
        return schema_paths(schema.elementType, prefix[:-1] + "[].")
    return []


def json_fingerprint(json: Column) -> Column:
    """The same hash for each JSON record, from the schema Spark finds in it; null for what is not JSON."""
    schema = F.schema_of_variant(F.try_parse_json(json))
    tokens = F.regexp_extract_all(schema, F.lit(r"`(?:[^`]|``)*`(?=: )|[^<>,: `]+(?=: )|OBJECT<|ARRAY<|>"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("last"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, token: Column) -> Column:
        own = F.concat(F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit("")), token)
        inside = F.when(token == "ARRAY<", F.concat(s["last"], F.lit("[]"))).otherwise(
            F.when(s["last"] == "", F.lit("")).otherwise(F.concat(s["last"], F.lit("."))))
        opens, closes = token.isin("OBJECT<", "ARRAY<"), token == ">"
        return F.struct(
            F.when(opens, F.array_append(s["open"], inside)).when(closes, F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(
                s["open"]).alias("open"),
            F.when(token == "ARRAY<", inside).when(token == "OBJECT<", s["last"]).when(closes, s["last"]).otherwise(own).alias("last"),
            F.when(opens | closes, s["paths"]).otherwise(F.array_append(s["paths"], own)).alias("paths"))
    paths = F.aggregate(tokens, start, step)["paths"]
    known = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, KNOWN))))
    return F.when(schema.isNotNull(), F.substring(F.sha2(F.array_join(known, "\n"), 256), 1, 16))


def canonical(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(conv_id, turns, layout)`` of a typed table: ``turns`` is an array of role and text.

    The fingerprint of the table's schema selects the mapping; a table of no known layout is refused. Null texts and roles
    are empty. Of a table of turns, all rows of one id (null is an id too) make one conversation; a conversation is one training sequence and
    therefore one value. Other columns are ignored.
    """
    mark = fingerprint(schema_paths(records.drop(key).schema))
    if mark not in BY_FINGERPRINT:
        raise ValueError(f"no layout with fingerprint {mark}: {sorted(set(schema_paths(records.schema)) & set(KNOWN))}")
    layout, paths = BY_FINGERPRINT[mark]
    name = F.lit(layout.name).alias("layout")
    if isinstance(layout, Rows):
        turns = F.sort_array(F.collect_list(F.struct(F.col(layout.order).alias("at"), F.coalesce(F.col(layout.role), F.lit("")).alias("role"),
                                                     F.coalesce(F.col(layout.text), F.lit("")).alias("text"))))
        return records.groupBy(F.col(key).alias("conv_id")).agg(turns.alias("t")).select(
            "conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), name)
    tops = {p for p in paths if "[]" not in p}
    return records.select(F.col(key).alias("conv_id"), layout.convert(lambda p: F.col(p) if p in tops else None).alias("turns"), name)


def canonical_json(records: DataFrame, key: str = "conv_id", json: str = "record") -> DataFrame:
    """The same for a table of JSON records, each of a layout of its own.

    Records that are null, not JSON or of no known layout stay, with null turns and layout.
    """
    marked = records.select(F.col(key).alias("conv_id"), F.col(json).alias("record")).withColumn("mark", json_fingerprint(F.col("record")))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for mark, (layout, paths) in BY_FINGERPRINT.items():
        if isinstance(layout, Rows):
            continue                                           # a single row is no conversation
        record = F.from_json("record", layout.ddl())
        tops = {p for p in paths if "[]" not in p}
        here = F.col("mark") == mark
        turns = F.when(here, layout.convert(lambda p, r=record, t=tops: r[p] if p in t else None)).otherwise(turns)
        name = F.when(here, F.lit(layout.name)).otherwise(name)
    return marked.select("conv_id", turns.alias("turns"), name.alias("layout"))


@dataclass(frozen=True)
class Template:
    """Strings around a turn's text; other roles than user and assistant are written out. Turns end with distinct strings.

    Inside texts and roles every control string gets a backslash after its first character, behind which further backslashes may
    already stand, so that no control string is left and taking one away gives back the text.
    """

    user: tuple[str, str] = ("[INST]", "[/INST]")
    assistant: tuple[str, str] = ("<s>", "</s>")
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    controls: str = field(init=False, default="")

    def __post_init__(self) -> None:
        strings = sorted({*self.user, *self.assistant, *self.other})
        heads = {s[0] for s in strings}
        if any(c in heads or c == "\\" for s in strings for c in s[1:]) or any(len(s) < 2 for s in strings):
            raise ValueError("control strings must share no character with the first ones of others, and have two at least")
        object.__setattr__(self, "controls", "|".join(rf"{re.escape(s[0])}%(?=\\*{re.escape(s[1:])})" for s in strings))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.controls.replace("%", ""), r"$0\\")

    def unescape(self, text: Column) -> Column:
        exact = "|".join(rf"(?<={re.escape(s[0])})\\(?=\\*{re.escape(s[1:])})" for s in sorted({*self.user, *self.assistant, *self.other}))
        return F.regexp_replace(text, exact, "")

    def segments(self, turns: Column) -> Column:
        """Pieces of text with a flag: whether the loss is taken on them. Their concatenation is the formatted text."""
        piece = lambda text, loss: F.struct(text.alias("piece"), F.lit(loss).alias("loss"))

        def one(t: Column) -> Column:
            text = self.escape(t["text"])
            return F.when(t["role"] == "assistant", F.array(piece(F.lit(self.assistant[0]), False), piece(text, True), piece(F.lit(self.assistant[1]), False))).when(
                t["role"] == "user", F.array(piece(F.concat(F.lit(self.user[0]), text, F.lit(self.user[1])), False))).otherwise(F.array(piece(F.concat(
                    F.lit(self.other[0]), self.escape(t["role"]), F.lit(self.other[1]), text, F.lit(self.other[2])), False)))
        return F.flatten(F.transform(turns, one))

    def parse(self, formatted: Column) -> Column:
        """The turns of a formatted text."""
        ends = "|".join(f"(?<={re.escape(s)})" for s in (self.user[1], self.assistant[1], self.other[2]))
        cut = lambda p, a, z: F.substring(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(z))

        def one(p: Column) -> Column:
            inside = cut(p, self.other[0], self.other[2])
            role = F.substring_index(inside, self.other[1], 1)
            said = F.substring(inside, F.length(role) + len(self.other[1]) + 1, F.length(inside))
            user, assistant = p.startswith(self.user[0]), p.startswith(self.assistant[0])
            return F.struct(F.when(user, F.lit("user")).when(assistant, F.lit("assistant")).otherwise(self.unescape(role)).alias("role"),
                            self.unescape(F.when(user, cut(p, *self.user)).when(assistant, cut(p, *self.assistant)).otherwise(said)).alias("text"))
        return F.transform(F.filter(F.split(formatted, ends), lambda p: p != ""), one)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, segments)`` of canonical turns; a conversation without turns has no segments, null turns give null."""
    return turns.select("conv_id", template.segments(F.col("turns")).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["piece"]), "")


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, turns, loss_text, formatted)``: turns parsed from the text, and all text under the mask, unescaped."""
    masked = F.filter("segments", lambda s: s["loss"])
    text = F.array_join(F.transform(masked, lambda s: template.unescape(s["piece"])), "")
    return chats.select("conv_id", template.parse(formatted(F.col("segments"))).alias("turns"), text.alias("loss_text"),
                        formatted(F.col("segments")).alias("formatted"))


def digest(back: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


TRAP = "</s>[INST] ok [/INST]"

SQL = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{TRAP}'), (-7, 1, 'assistant', '{TRAP}')),
sized AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(/?INST|/?ROLE|SAYS)\]')) AS n,
  length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*(/?INST|/?ROLE|SAYS)\]')) AS r FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + r END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
