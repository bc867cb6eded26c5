"""Chat formatting: a state machine over roles, a declarative template, and per-segment loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn of each role, and whether its text counts in the loss.

    Roles that are not named take `other`, whose opening holds the role itself.  `turns` are the
    machine's transitions from state to state by role; `ends` are the states a conversation may end in.
    """

    marks: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n\n", False),
            "user": ("<s>[INST] ", " [/INST]", False),
            "assistant": (" ", " </s>", True),
        }
    )
    other: tuple[str, str, str, bool] = ("<<ROLE>>", "<<:>>", "<</ROLE>>", False)
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    ends: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        found = {m.strip() for a, b, _ in self.marks.values() for m in (a, b)} | {m.strip() for m in self.other[:3]}
        found |= {"<s>", "</s>"}
        return sorted((m for m in found if m), key=lambda m: (-len(m), m))


class Formatter:
    """Formats conversations and reads them back."""

    def __init__(self, template: Template) -> None:
        self.template = template
        rest = [(m[0], re.escape(m[1:])) for m in template.controls()]
        self._inside = re.compile("|".join(f"(?:{re.escape(a)}(?={b}))" for a, b in rest))
        kinds = [*template.marks.items(), (None, (template.other[0], template.other[2], template.other[3]))]
        self._kinds = sorted(kinds, key=lambda k: -len(k[1][0]))

    def escape(self, text: str) -> str:
        """Double each escape character, then put one after the first character of each control string."""
        return self._inside.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """(text, loss flag) pieces; joined they are the formatted conversation."""
        out: list[tuple[str, bool]] = []
        for role, text in turns:
            if role in self.template.marks:
                before, after, loss = self.template.marks[role]
            else:
                begin, middle, after, loss = self.template.other
                before = begin + self.escape(role) + middle
            out += [(before, False), (self.escape(text), loss), (after, False)]
        return out

    def parse(self, formatted: str) -> list[tuple[str, str, bool]]:
        """(role, text, loss flag) of each turn, from the formatted string alone."""
        out, at = [], 0
        while at < len(formatted):
            for role, (before, after, loss) in self._kinds:
                if formatted.startswith(before, at):
                    break
            else:
                raise ValueError(f"no turn starts at {at}")
            at += len(before)
            if role is None:
                upto = formatted.index(self.template.other[1], at)
                role, at = self.unescape(formatted[at:upto]), upto + len(self.template.other[1])
            upto = formatted.index(after.strip(), at)
            lead = len(after) - len(after.lstrip())
            out.append((role, self.unescape(formatted[at : upto - lead]), loss))
            at = upto - lead + len(after)
        return out

    def check(self, roles: list[str]) -> str | None:
        """None if the machine accepts the turn order, else what is wrong."""
        state = "start"
        for i, role in enumerate(roles):
            if role not in self.template.turns.get(state, {}):
                return f"turn {i}: {role or 'no role'} after {state}"
            state = self.template.turns[state][role]
        return None if state in self.template.ends else f"ends after {state}"


def _format(template: Template, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Formatter(template)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for turns in part.column("turns").to_pylist():
                    pairs = [(t["role"] or "", t["text"] or "") for t in turns]
                    segments = form.segments(pairs)
                    formatted = "".join(s for s, _ in segments)
                    problem = form.check([r for r, _ in pairs])
                    if full:
                        rows.append((formatted, [{"text": s, "loss": f} for s, f in segments], problem))
                        continue
                    back = form.parse(formatted)
                    turned = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _ in back).encode()).hexdigest()
                    loss = "".join(t for _, t, f in back if f)
                    rows.append((len(back), turned, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), problem is None, problem))
                kinds = FULL if full else DIGEST
                cols = [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), *cols], names=["conv_id", *(n for n, _ in kinds)])

    return run


_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
FULL = [("formatted", pa.string()), ("segments", _SEGMENT), ("problem", pa.string())]
DIGEST = [
    ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("problem", pa.string()),
]


def _grouped(conversations: DataFrame) -> DataFrame:
    """One row per conversation; a row without conv_id stands alone, so that such rows never meet in one."""
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    rows = conversations.select("conv_id", alone, F.struct("turn", "role", "text").alias("turn"))
    return rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: conv_id, formatted, segments (text, loss) and problem (null: the machine accepts it).

    Rows are put in order of turn (null first), then role and text, so ties and repeated rows have one
    order.  A null text or role is empty.  Conversations with a problem are formatted as well; a caller
    that wants valid ones filters on `problem`.  Each row without conv_id is a conversation of its own.
    A conversation is one training text, so all its turns meet in one row.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, formatted string, segments array<struct<text:string,loss:boolean>>, problem string"
    return _grouped(conversations).mapInArrow(_format(template or Template(), True), ddl)


def digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """What is read back from each formatted conversation: counts and hashes of turns and of the text under the loss."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, problem string"
    return _grouped(conversations).mapInArrow(_format(template or Template(), False), ddl)


def with_hostile(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The rows plus conversation -7, whose texts look like the template's own marks."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    cast: list[Column] = [F.col(c).cast(conversations.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "role", "text")]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra.select(*cast))
