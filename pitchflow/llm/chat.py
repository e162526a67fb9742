"""Chat formatting: a finite-state machine over roles and a declarative template.

A template says how a turn begins and ends, which roles are learnt and which role may follow which. Every turn gives
three segments (opening, text, closing); a segment says whether its text counts for the loss. Texts and roles are escaped
so that no control string of the template can occur in them, and ``unescape`` takes that back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """``open`` has the place {role}. Control strings begin with ``mark``, which escaped texts never hold."""

    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"
    mark: str = "<|"
    learnt: tuple[str, ...] = ("assistant",)
    follow: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )
    last: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column, mark: str = "<|") -> Column:
    """A backslash before each backslash and inside each control mark."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))


def escape_role(role: Column, mark: str = "<|") -> Column:
    return F.replace(escape(role, mark), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def segments(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, place, part, text, loss, turn_ok, prior: the segments of every turn; in order of place and part they are
    the formatted conversation.

    Turns go by turn (nulls first), then role, then text; repeated rows are turns of their own. ``turn_ok`` is the
    machine's verdict on the step from the role before (``prior``) to this one; a turn that breaks the order is still
    formatted. Null roles and texts are empty. Extra columns are ignored.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("said"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    steps = [f"{a}>{b}" for a, bs in template.follow.items() for b in bs]
    prior = F.coalesce(F.lag("role").over(order), F.lit(START))
    known = turns.select(
        "conv_id", "role", "said", F.row_number().over(order).alias("place"), prior.alias("prior")
    ).withColumn("turn_ok", F.concat_ws(">", "prior", "role").isin(steps))
    first, after = template.open.split("{role}")
    parts = F.array(
        F.struct(
            F.lit(0).alias("part"),
            F.concat(F.lit(first), escape_role(F.col("role"), template.mark), F.lit(after)).alias("text"),
            F.lit(False).alias("loss"),
        ),
        F.struct(
            F.lit(1).alias("part"),
            escape(F.col("said"), template.mark).alias("text"),
            F.col("role").isin(*template.learnt).alias("loss"),
        ),
        F.struct(F.lit(2).alias("part"), F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
    )
    return known.select("conv_id", "place", F.inline(parts), "turn_ok", "prior").select(
        "conv_id", "place", "part", "text", "loss", "turn_ok", "prior"
    )


class _Reader:
    """Parses the segments of one conversation as they come; holds one turn at a time."""

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template = conv_id, template
        first, after = (re.escape(x) for x in template.open.split("{role}"))
        self.turn = re.compile(f"{first}(.*?){after}(.*?){re.escape(template.close)}", re.S)
        self.held: list[str] = []
        self.turns, self.learnt = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.ok, self.role = True, START

    def add(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        self.held.append(text)
        if loss:
            said = unescape(text)
            self.loss_chars += len(said)
            self.learnt.update(said.encode("utf-8", "surrogatepass"))
        if text.endswith(self.template.close):
            buffer = "".join(self.held)
            at = 0
            while m := self.turn.match(buffer, at):
                at = m.end()
                role, said = unescape_role(m[1]), unescape(m[2])
                self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                self.n_turns += 1
                self.ok &= role in self.template.follow.get(self.role, ())
                self.role = role
            self.held = [buffer[at:]]

    def row(self) -> dict:
        if "".join(self.held):
            raise ValueError(f"conversation {self.conv_id} does not end with a whole turn")
        return {
            "conv_id": self.conv_id,
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.learnt.hexdigest(),
            "formatted_chars": self.chars,
            "valid": self.ok and self.role in self.template.last,
        }


DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("valid", pa.bool_()),
    ]
)


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row for each conversation of a table of ``segments``, from its formatted text and loss flags alone.

    Segments stream in order through the reader, which keeps running digests, so a very long conversation needs no more
    memory than its longest turn. Rows whose conv_id is null are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = None, []
        for batch in batches:
            for conv, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if reader is None or reader.conv_id != conv:
                    if reader:
                        rows.append(reader.row())
                    reader = _Reader(conv, template)
                reader.add(text, loss)
            if len(rows) > 1000:
                yield pa.RecordBatch.from_pylist(rows, DIGEST)
                rows = []
        if reader:
            rows.append(reader.row())
        yield pa.RecordBatch.from_pylist(rows, DIGEST)

    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part")
    return dealt.select(F.col("conv_id").cast("long").alias("conv_id"), "text", "loss").mapInArrow(run, kind)
