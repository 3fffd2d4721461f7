"""Chat formatting: a finite-state machine checks the turns, a declarative template makes the text and its loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches


@dataclass(frozen=True)
class Template:
    """parts of a turn: ("mark", text) is literal, ("role",) and ("text",) are filled in. Only texts of loss roles are trained on.

    Every mark that ends a filled-in part begins with control or stands in apart.
    """

    parts: tuple = (("mark", "<|im_start|>"), ("role",), ("mark", "\n"), ("text",), ("mark", "<|im_end|>\n"))
    loss_roles: frozenset = frozenset({"assistant"})
    #: Control strings start with this. Inside a role or text, one more of its last character follows it, so no control string can occur there.
    control: str = "<|"
    #: Marks that do not start with control, which roles must not hold: there, control and this letter stand for them.
    apart: dict = field(default_factory=lambda: {"\n": "n"})
    #: From a state and a role to the next state; what is missing is an error.
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: frozenset = frozenset({"assistant"})

    def escape(self, text: str, kind: str = "text") -> str:
        text = text.replace(self.control, self.control + self.control[-1])
        for mark, letter in self.apart.items() if kind == "role" else ():
            text = text.replace(mark, self.control + letter)
        return text

    def unescape(self, text: str) -> str:
        back = {self.control[-1]: self.control} | {letter: mark for mark, letter in self.apart.items()}
        return re.sub(re.escape(self.control) + "([" + re.escape("".join(back)) + "])", lambda m: back[m[1]], text)

    @cached_property
    def turn(self) -> re.Pattern:
        """What a formatted turn looks like."""
        return re.compile("".join(re.escape(p[1]) if p[0] == "mark" else f"(?P<{p[0]}>.*?)" for p in self.parts), re.S)

    def read(self, formatted: str, loss: list[tuple[int, int]]) -> Iterator[tuple[str, str, str]]:
        """(role, text, trained text) of the turns that formatted text holds; loss are the spans under the mask, in order."""
        at, spans = 0, iter(loss)
        span = next(spans, None)
        while at < len(formatted):
            found = self.turn.match(formatted, at)
            if not found:
                raise ValueError(f"no turn at {at}")
            at, own = found.end(), []
            while span and span[0] < at:
                own.append(formatted[span[0] : span[1]])
                span = next(spans, None)
            yield self.unescape(found["role"]), self.unescape(found["text"]), self.unescape("".join(own))


SEGMENTS = "conv_id long, turn_no long, part int, kind string, segment string, loss boolean, state string, ends boolean, valid boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _sorted(turns: DataFrame) -> DataFrame:
    bound_batches(turns.sparkSession)
    own = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return own.select("conv_id", "role", "text")


def _walk(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[list[tuple]]:
    """Rows of SEGMENTS, a list for each batch. Memory: one batch and the state of one conversation."""
    none = object()
    now, state, number, waiting = none, "start", 0, None
    for batch in batches:
        out = []
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is none or conv != now:
                if waiting:
                    out += _close(waiting, state, template)
                now, state, number = conv, "start", 0
            elif waiting:
                out += waiting
            state = template.moves.get((state, role), "error") if state != "error" else state
            waiting = []
            for i, part in enumerate(template.parts):
                made = part[1] if part[0] == "mark" else template.escape(role if part[0] == "role" else text, part[0])
                waiting.append((conv, number, i, part[0], made, part[0] == "text" and role in template.loss_roles, state, False, None))
            number += 1
        yield out
    if waiting:
        yield _close(waiting, state, template)


def _close(rows: list[tuple], state: str, template: Template) -> list[tuple]:
    return [*rows[:-1], (*rows[-1][:-2], True, state in template.final)]


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each piece of formatted text, with its loss flag: conv_id, turn_no (from 0), part, kind, segment, loss.

    state is the machine's state after the turn ("error" from the first turn that breaks the order), ends marks the last
    segment of a conversation and valid, there only, whether the conversation is well formed. Conversations that are not
    are formatted all the same. Null roles and texts are empty; rows of a null conv_id are one conversation; turns are
    taken by turn number (null first), ties by role and text; repeated rows are repeated turns; extra columns are not
    read; an empty table gives an empty one. A conversation is formatted by one task, through which its turns stream in
    order, so one of any length needs no more memory than a batch (its rows are sorted there, on disk if they must).
    """
    template = template or Template()

    def run(batches):
        for rows in _walk(batches, template):
            yield _batch(rows, SEGMENTS)

    return _sorted(turns).mapInArrow(run, SEGMENTS)


def digests(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, read back from its formatted text by the template: turns, what is under the loss mask, and length.

    Same cases as segments(). The text is parsed turn by turn as it comes, so nothing of a conversation is held.
    """
    template = template or Template()

    def run(batches):
        turns_, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = trained = 0
        formatted, spans, at = [], [], 0
        for rows in _walk(batches, template):
            done = []
            for conv, _, part, _, made, flag, _, ends, valid in rows:
                formatted.append(made)
                if flag:
                    spans.append((at, at + len(made)))
                at += len(made)
                if part < len(template.parts) - 1:
                    continue
                for role, text, taught in template.read("".join(formatted), spans):
                    n += 1
                    turns_.update(f"{role}\n{text}\n".encode())
                    trained += len(taught)
                    loss.update(taught.encode())
                chars += at
                formatted, spans, at = [], [], 0
                if ends:
                    done.append((conv, n, turns_.hexdigest(), trained, loss.hexdigest(), chars, valid))
                    turns_, loss = hashlib.sha256(), hashlib.sha256()
                    n = chars = trained = 0
            yield _batch(done, DIGEST)

    return _sorted(turns).mapInArrow(run, DIGEST)
