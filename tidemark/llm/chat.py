"""Chat formatting with a checked grammar round trip, in DataFrame functions only.

A turn is rendered as four control strings around its role and text::

    <s> role [INST] text [/INST]</s>

The parser is deterministic: it cuts the rendered text at every control string, demands that the
control strings repeat in exactly that order with nothing in between, and undoes one level of
escaping in roles and texts. A turn is first rendered as it is and parsed again. Only if that does not give
back the source (its content holds a control string, or looks like an escaped one), the content is
escaped by a backslash after the first character of each control string, and the check repeats.
Backslashes stack, so that already escaped content gains one more and stays distinct. Whole
conversations are parsed once more at the end, and a difference fails the job.

Defined results: a null role or text is empty; turns are ordered by turn, then role, then text, null
turn first, so ties are deterministic; repeated rows are repeated turns; a null conversation id is a
conversation of its own; texts are never cut; an empty table gives no rows; extra columns are ignored.

Scale: escaping and the first check are row-local; one shuffle brings the turns of a conversation
together, as the output, one text for each conversation, demands. Everything about a conversation is
linear in its length: offsets are a running sum over its rows, and no text is cut up twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import let

LOSS_ROLE = "assistant"


def _quoted(s: str) -> str:
    """``s`` for a Java regular expression."""
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in s)


@dataclass(frozen=True)
class Template:
    """Four distinct control strings: before the role, before the text, after the text, after the turn."""

    turn: str
    text: str
    end_text: str
    end_turn: str

    @property
    def controls(self) -> tuple[str, str, str, str]:
        return (self.turn, self.text, self.end_text, self.end_turn)

    @property
    def pattern(self) -> str:
        return "|".join(map(_quoted, sorted(self.controls, key=len, reverse=True)))

    @property
    def _after(self) -> list[tuple[str, str]]:
        return [(_quoted(c[0]), _quoted(c[1:])) for c in self.controls]

    def escape(self, c: Column) -> Column:
        spots = "|".join(rf"(?<={a})(?=\\*{b})" for a, b in self._after)
        return F.regexp_replace(c, spots, r"\\")

    def unescape(self, c: Column) -> Column:
        spots = "|".join(rf"(?<={a})\\(?=\\*{b})" for a, b in self._after)
        return F.regexp_replace(c, spots, "")

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.turn), role, F.lit(self.text), text, F.lit(self.end_text + self.end_turn))

    def parse(self, c: Column) -> Column:
        """Turns as array of (role, text); null if the text is not of the grammar."""
        cut = F.struct(F.split(c, self.pattern, -1).alias("pieces"), F.regexp_extract_all(c, F.lit(self.pattern), F.lit(0)).alias("found"))

        def turns(x: Column) -> Column:
            pieces, n = x["pieces"], (F.size(x["found"]) / 4).cast("int")
            order = F.flatten(F.array_repeat(F.array(*map(F.lit, self.controls)), n))
            bare = F.size(F.filter(pieces, lambda p, i: (i % 4 != 1) & (i % 4 != 2) & (p != ""))) == 0
            at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
            got = F.transform(at, lambda i: F.struct(self.unescape(F.get(pieces, i * 4 + 1)).alias("role"), self.unescape(F.get(pieces, i * 4 + 2)).alias("text")))
            return F.when((order == x["found"]) & bare, got)

        return let(cut, turns)


INST = Template("<s>", "[INST]", "[/INST]", "</s>")
CHATML = Template("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_next|>")


def render_turns(turns: DataFrame, template: Template = INST, role: str = "role", text: str = "text") -> DataFrame:
    """Adds ``__body`` (role and text as rendered) and ``__level`` (escapes: 0 none, 1 once)."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    source = F.array(F.struct(r.alias("role"), t.alias("text")))

    def attempt(level: int) -> Column:
        a, b = (r, t) if level == 0 else (template.escape(r), template.escape(t))
        return F.struct(a.alias("role"), b.alias("text"), F.lit(level).alias("level"))

    def holds(level: int) -> Column:
        x = attempt(level)
        return F.coalesce(template.parse(template.render(x["role"], x["text"])) == source, F.lit(False))

    body = F.when(holds(0), attempt(0)).when(holds(1), attempt(1)).otherwise(F.raise_error(F.lit("a turn cannot be rendered reversibly")))
    return turns.withColumn("__body", body)


CHAT = "formatted string, loss array<struct<start: int, end: int, turn: int, turn_start: int>>, n_turns int, n_escaped int"


def format_chats(turns: DataFrame, template: Template = INST, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv, formatted, loss, n_turns, n_escaped): loss has code point spans of the texts to learn from.

    A span also says which turn it is in and where that turn starts, so that it is read without
    counting from the start of a long conversation.
    """
    rows = render_turns(turns.select(F.col(conv), F.col(turn), F.col(role), F.col(text)), template, role, text)
    width = sum(map(len, template.controls))
    order = [F.col(turn), F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))]
    size = width + F.length("__body.role") + F.length("__body.text")
    before = Window.partitionBy(conv).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    one = F.struct(order[0].alias("turn"), order[1].alias("role"), order[2].alias("text"), F.col("__at").alias("at"), F.col("__body").alias("body"))
    chats = rows.groupBy(conv).agg(F.array_sort(F.collect_list(one)).alias("t"))
    t = F.col("t")
    head = len(template.turn + template.text)

    def span(x: Column, i: Column) -> Column:
        start = x["at"] + head + F.length(x["body"]["role"])
        return F.when(x["role"] == loss_role, F.struct(start.alias("start"), (start + F.length(x["body"]["text"])).alias("end"), i.alias("turn"), x["at"].alias("turn_start")))

    made = chats.select(
        conv,
        F.array_join(F.transform(t, lambda x: template.render(x["body"]["role"], x["body"]["text"])), "").alias("formatted"),
        F.filter(F.transform(t, span), lambda s: s.isNotNull()).alias("loss"),
        F.size(t).alias("n_turns"),
        F.size(F.filter(t, lambda x: x["body"]["level"] > 0)).alias("n_escaped"),
        F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("__source"),
    )
    same = F.coalesce(template.parse(F.col("formatted")) == F.col("__source"), F.lit(False))
    return made.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not parse back")))).drop("__source")


def loss_texts(chats: DataFrame, template: Template = INST) -> Column:
    """The unescaped texts under the loss mask of a formatted conversation, as an array."""

    def texts(rows: Column) -> Column:
        return F.transform(chats["loss"], lambda s: template.unescape(F.substring(F.get(rows, s["turn"]), s["start"] - s["turn_start"] + 1, s["end"] - s["start"])))

    return let(F.split(chats["formatted"], _quoted(template.end_turn), -1), texts)
