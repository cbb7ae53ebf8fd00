"""Chat formatting: a finite-state machine over roles emits text segments with loss flags from a template.

Conversations are sorted inside their partition and streamed through the machine turn by turn, so a conversation of any
length needs the memory of one batch of rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What stands around each role's text, which texts carry loss, and which role may follow which.

    ``around`` has (before, after) by role; the entry ``*`` is for other roles and its ``{role}`` is replaced by the
    escaped role. ``controls`` are the strings that mark turns. ``follows`` maps a state to the roles it admits; the
    states are ``start`` and the last role; ``ends`` are the roles a conversation may end on."""

    around: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "*": ("[ROLE] {role} [:] ", " [/ROLE]"),
    })
    controls: tuple[str, ...] = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[:]", "[/ROLE]")
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    ends: tuple[str, ...] = ("user", "assistant")
    escape: str = "\\"

    def special(self) -> str:
        """The escape and the first characters of control strings: what a text must not hold unescaped."""
        return "".join(dict.fromkeys([self.escape, *(c[0] for c in self.controls)]))

    def escaped(self, text: str) -> str:
        for c in self.special():  # the escape itself comes first
            text = text.replace(c, self.escape + c)
        return text

    def unescaped(self, text: str) -> str:
        """Whole replacements, without a step per character: a first character never stands without its own escape, so
        its pairs are found anywhere; then all runs of escapes are pairs."""
        for c in reversed(self.special()):
            text = text.replace(self.escape + c, c)
        return text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Mark, text, mark; only the text of a loss role carries loss."""
        before, after = self.around.get(role) or self.around["*"]
        return [(before.replace("{role}", self.escaped(role)), False), (self.escaped(text), role in self.loss_roles), (after, False)]

    def admits(self, state: str, role: str) -> bool:
        return role in self.follows.get(state, ())

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of formatted turns, one or a whole conversation. Unescaped control strings come from the
        template alone, so a text ends at the first unescaped character that may begin one."""
        stop = re.compile(f"{re.escape(self.escape)}.|[{re.escape(self.special()[1:])}]", re.S)

        def until(mark: str, at: int) -> tuple[str, int]:
            """What stands before ``mark``, and where it ends."""
            lead = next(k for k, c in enumerate(mark) if c in self.special())
            end = next((m.start() for m in stop.finditer(formatted, at) if m[0][0] != self.escape), len(formatted)) - lead
            if not formatted.startswith(mark, end):
                raise ValueError(f"no {mark!r} at {end}")
            return self.unescaped(formatted[at:end]), end + len(mark)

        out, at = [], 0
        while at < len(formatted):
            for role, (a, z) in self.around.items():
                head, _, rest = a.partition("{role}")
                if formatted.startswith(head, at):
                    at += len(head)
                    if role == "*":
                        role, at = until(rest, at)
                    text, at = until(z, at)
                    out.append((role, text))
                    break
            else:
                raise ValueError(f"no turn begins at {at}")
        return out


def format_turns(turns: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv, ``pos`` (from 0), ``segments`` (array of text and loss) and ``state``.

    ``state`` is ``ok``, or says what the machine did not admit: ``order`` (the role may not follow), ``turn`` (the turn
    number repeats or is missing). Nothing is dropped: such turns are formatted too and the machine goes on from their
    role. Rows of a conversation are ordered by turn, nulls first, then role and text, so ties have one order; repeated
    rows are turns each. Null role and text count as empty; rows with a null conversation form one conversation. Very
    long texts are replaced in whole, with a few times their size of memory. The turns of one conversation follow one
    another through one task, a batch of rows at a time, as each turn's state depends on the one before. Other columns
    are ignored whatever their names. An empty table gives an empty table.
    """
    template = template or ChatTemplate()
    kind = turns.schema[conv].dataType.simpleString()
    rows = turns.select(F.col(conv).cast("string").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (object(), None, "start", 0)
        for x in parts:
            out = []
            for c, t, r, s in zip(x["conv"].tolist(), x["turn"].tolist(), x["role"], x["text"]):
                t = None if pd.isna(t) else t
                same = c == last[0]
                before, state, pos = (last[1], last[2], last[3]) if same else (None, "start", 0)
                said = "turn" if t is None or same and t == before else "ok" if template.admits(state, r) else "order"
                out.append((c, pos, [{"text": a, "loss": b} for a, b in template.segments(r, s)], r, said))
                last = (c, t, r, pos + 1)
            yield pd.DataFrame(out, columns=["conv", "pos", "segments", "role", "state"])

    out = rows.mapInPandas(run, "conv string, pos long, segments array<struct<text: string, loss: boolean>>, role string, state string")
    return out.select(F.col("conv").cast(kind).alias(conv), "pos", "segments", "role", "state")


def read_back(formatted: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, from the formatted segments alone: ``n_turns``, ``turns_sha256`` (role, newline, text,
    newline per turn), ``loss_chars`` and ``loss_sha256`` (the unescaped text under the loss mask), ``formatted_chars``,
    ``valid`` (the machine admitted every turn and the end) and ``first_error``. Turns are digested in order, one at a time.
    Other columns are ignored. An empty table gives an empty table."""
    template = template or ChatTemplate()
    kind = formatted.schema[conv].dataType.simpleString()
    columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_error"]
    rows = formatted.select(F.col(conv).cast("string").alias("conv"), "pos", "segments", "state").repartition("conv").sortWithinPartitions("conv", "pos")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = object(), None

        def done() -> tuple:
            n, turns, chars, loss, size, error, role = own
            error = error or (None if role in template.ends else "end")
            return (now, n, turns.hexdigest(), chars, loss.hexdigest(), size, error is None, error)

        for x in parts:
            out = []
            for c, segments, state in zip(x["conv"].tolist(), x["segments"], x["state"]):
                if own is None or c != now:
                    if own is not None:
                        out.append(done())
                    now, own = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, None, ""]
                whole = "".join(s["text"] for s in segments)
                for role, text in template.parse(whole):
                    own[0] += 1
                    own[1].update(f"{role}\n{text}\n".encode())
                    own[6] = role
                for s in segments:
                    if s["loss"]:
                        text = template.unescaped(s["text"])
                        own[2] += len(text)
                        own[3].update(text.encode())
                own[4] += len(whole)
                own[5] = own[5] or (None if state == "ok" else state)
            yield pd.DataFrame(out, columns=columns)
        if own is not None:
            yield pd.DataFrame([done()], columns=columns)

    schema = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_error string"
    out = rows.mapInPandas(run, schema)
    return out.select(F.col("conv").cast(kind).alias(conv), *columns[1:])
