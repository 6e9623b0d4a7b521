"""Chat formatting: a finite-state machine over roles and a declarative template.

A template gives each role its opening and closing string and says which roles are learned from. The text of a turn is
escaped, so that no control string and no escape sign of the template survives inside it; the formatted text can
therefore be taken apart again without loss. Output of ``format_turns`` is one row per segment (opening, body, closing)
with its loss flag: no row ever holds a whole conversation.

The machine reads the role of each turn in order: an optional system turn first, then user and assistant in turn, the
assistant last. Its state after a turn is that turn's role, so a step needs only the turn before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States of the machine and the roles that may follow each; "" is the start.
FOLLOWS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("assistant",)


@dataclass(frozen=True)
class Template:
    """Opening string of a turn (``{role}`` is its name), closing string, roles under the loss mask, escape sign."""

    opening: str = "### {role}: "
    closing: str = " </turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: tuple[str, ...] = ("assistant",)
    escape: str = "\\"
    #: Strings that may not stand unescaped inside a text; an escape sign goes in front of each.
    controls: tuple[str, ...] = ("###", "</turn>")

    def __post_init__(self) -> None:
        head, tail = self.opening.split("{role}")
        marks = (head.strip(), self.closing.strip())
        if any(not any(c in mark for c in self.controls) for mark in marks):
            raise ValueError("opening and closing must each hold a control string, else a text could imitate them")
        if not tail.strip():
            raise ValueError("a sign must end the role in the opening string")


def specials(template: Template, name: bool = False) -> str:
    """What is escaped in a text; in a role's own name also the sign that ends it."""
    ends = (template.opening.split("{role}")[1].strip(),) * name
    return "|".join(re.escape(c) for c in (template.escape, *template.controls, *ends))


def escaped(text: F.Column, template: Template, name: bool = False) -> F.Column:
    literal = template.escape.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, f"({specials(template, name)})", literal + "$1")


def unescape(text: str, template: Template, name: bool = False) -> str:
    return re.sub(f"{re.escape(template.escape)}({specials(template, name)})", r"\1", text)


def turn_pattern(template: Template) -> re.Pattern[str]:
    """One formatted turn: a body is escaped specials and characters that start none."""
    special = specials(template)
    body = f"((?:{re.escape(template.escape)}(?:{special})|(?!{special}).)*)"
    head, tail = template.opening.split("{role}")
    special = specials(template, name=True)
    name = f"((?:{re.escape(template.escape)})?(?:{re.escape(template.escape)}(?:{special})|(?!{special}).)*)"
    return re.compile(re.escape(head) + name + re.escape(tail) + body + re.escape(template.closing), re.S)


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of all conversations: conv_id, turn, part (0 opening, 1 body, 2 closing), role, segment, loss, allowed.

    Null text is empty; a null role is the role "". A role that the template doesn't name opens under its own name, escaped and after an escape sign, so it can't pass for a known one.
    ``allowed`` says whether the machine may take this turn after the one before it (and, for the last turn, end there).
    Turns with equal number are ordered by role, then text. Extra columns are ignored.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before, after = F.lag("role").over(order), F.lead("role").over(order)
    may = F.lit(False)
    for state, roles in FOLLOWS.items():
        came = before.isNull() if state == "" else before == state
        may = may | (F.coalesce(came, F.lit(False)) & F.col("role").isin(*roles))
    named = F.concat(F.lit(template.escape), escaped(F.col("role"), template, name=True))
    for known, name in template.names.items():
        named = F.when(F.col("role") == known, F.lit(name)).otherwise(named)
    head, tail = template.opening.split("{role}")
    learned = F.col("role").isin(*template.learned)
    segments = F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit(head), named, F.lit(tail)).alias("segment"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), escaped(F.col("text"), template).alias("segment"), learned.alias("loss")),
        F.struct(F.lit(2).alias("part"), F.lit(template.closing).alias("segment"), F.lit(False).alias("loss")),
    )
    placed = turns.withColumns({"place": F.row_number().over(order), "allowed": may & (after.isNotNull() | F.col("role").isin(*FINAL))})
    return placed.select("conv_id", "turn", "place", "role", "allowed", F.explode(segments).alias("s")).select("conv_id", "turn", "place", "role", "allowed", "s.*")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


class Reader:
    """Reads one formatted conversation as it streams by and keeps digests and the turn at hand only."""

    def __init__(self, conv_id: int | None, template: Template, pattern: re.Pattern[str]) -> None:
        self.conv_id, self.template, self.pattern = conv_id, template, pattern
        self.roles = {name: role for role, name in template.names.items()}
        self.turns, self.learned, self.chars, self.valid, self.rest = 0, 0, 0, True, ""
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, loss: bool, allowed: bool) -> None:
        self.chars += len(segment)
        self.valid &= allowed
        if loss:
            plain = unescape(segment, self.template)
            self.learned += len(plain)
            self.loss.update(plain.encode())
        self.rest += segment
        if not segment.endswith(self.template.closing):
            return
        while turn := self.pattern.match(self.rest):
            name, body = turn[1], unescape(turn[2], self.template)
            role = self.roles[name] if name in self.roles else unescape(name[len(self.template.escape) :], self.template, name=True)
            self.all.update(f"{role}\n{body}\n".encode())
            self.turns += 1
            self.rest = self.rest[turn.end() :]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv_id}: text after the last turn can't be read")
        return self.conv_id, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars, self.valid


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse the formatted text again: a row per conversation with digests of its turns and of the text under the loss mask.

    The segments of a conversation stream through one task in order and only digests are held, so a conversation of any
    length needs the memory of one batch. No turns give no row.
    """
    pattern = turn_pattern(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Reader | None = None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict(dict(zip(names, zip(*done))), schema=schema)
            done.clear()
            return out

        for batch in batches:
            for conv, segment, loss, allowed in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss", "allowed"))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Reader(conv, template, pattern)
                now.feed(segment, loss, allowed)
            if len(done) > 4096:
                yield flush()
        if now is not None:
            done.append(now.row())
        if done:
            yield flush()

    names = [f.split()[0] for f in DIGEST.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))))
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part")
    return dealt.select("conv_id", "segment", "loss", "allowed").mapInArrow(run, DIGEST)


PROBE = "\\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts imitate the template's own signs."""
    spark = conversations.sparkSession
    schema = "conv_id long, turn long, role string, text string"
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], schema)
    return conversations.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")]).unionByName(probe)
