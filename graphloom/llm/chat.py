"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names the marks around each role's text and which roles are learned. Texts keep their characters, but each
start of a control string inside a text is broken by the escape character after its first character, as is an unfinished
control string at a text's end, and the escape character is doubled; so the formatted text holds control strings only
where the template put them, and unescaping gives the texts back.

:func:`format_turns` emits one row per segment (mark or text) with a loss flag, streaming over turns sorted by
conversation, so a conversation of any length takes bounded memory. :func:`digest` parses segments into turns again, by :meth:`Template.turns`.

Defined cases: null texts and roles are empty; turns are ordered by turn, role, text (null turns first), and repeated
rows are separate turns; rows with a null conv_id form one conversation; roles the template does not know are written
between role marks; an order of roles that the machine does not allow is formatted too and has valid = false; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_arrow, shuffle_partitions


@dataclass(frozen=True)
class Template:
    """Marks before and after each role's text, learned roles, allowed successors of each role ("" is the start)."""

    marks: dict[str, tuple[str, str]]
    learned: frozenset[str]
    follows: dict[str, tuple[str, ...]]
    name_marks: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    other_end: str = "</s>"
    escape: str = "\\"
    pattern: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        controls = self.controls()
        if any(len(c) < 2 or self.escape in c for c in controls):
            raise ValueError("control strings need two characters and no escape character")
        ends = {c[:k] for c in controls for k in range(1, len(c))}
        starts = "|".join([*map(re.escape, controls), *(re.escape(e) + r"\Z" for e in sorted(ends))])
        first = "".join(sorted({re.escape(c[0]) for c in controls}))
        object.__setattr__(self, "pattern", re.compile(rf"{re.escape(self.escape)}|(?=(?:{starts}))[{first}]", re.S))

    def controls(self) -> list[str]:
        found = {x for pair in self.marks.values() for x in pair if x} | {*self.name_marks, self.other_end}
        return sorted(found, key=lambda c: (-len(c), c))

    def escaped(self, text: str) -> str:
        return self.pattern.sub(lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.?)", lambda m: m[1], text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn with their loss flags; marks are never learned."""
        if role in self.marks:
            before, after = self.marks[role]
            parts = [(before, False), (self.escaped(text), role in self.learned), (after, False)]
        else:
            parts = [(self.name_marks[0], False), (self.escaped(role), False), (self.name_marks[1], False), (self.escaped(text), role in self.learned), (self.other_end, False)]
        return parts

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of a formatted conversation."""
        cut = re.compile("|".join(map(re.escape, self.controls())))
        opening = {b: (r, a) for r, (b, a) in self.marks.items() if b}
        bare = next(((r, a) for r, (b, a) in self.marks.items() if not b), None)
        found, at = [], 0
        while at < len(formatted):
            m = cut.match(formatted, at)
            if m and m[0] == self.name_marks[0]:
                e = cut.search(formatted, m.end())
                role, at = self.unescaped(formatted[m.end() : e.start()]), e.end()
                end = self.other_end
            elif m and m[0] in opening:
                (role, end), at = opening[m[0]], m.end()
            else:
                role, end = bare
            e = cut.search(formatted, at)
            if e is None or e[0] != end:
                raise ValueError(f"{end!r} is due at {at}")
            found.append((role, self.unescaped(formatted[at : e.start()])))
            at = e.end()
        return found


#: The default template's marks.
INSTRUCT = Template(
    marks={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")},
    learned=frozenset({"assistant"}),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])


def format_turns(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments (conv_id, turn_no, part, segment, loss, valid); valid: every turn so far followed an allowed role."""
    rows = turns.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    rows = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, number, last, valid = object(), 0, "", True
        for b in batches:
            out = {c: [] for c in _SEGMENTS.names}
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if c != conv:
                    conv, number, last, valid = c, 0, "", True
                role = role or ""
                valid &= role in template.follows.get(last, ())
                for k, (segment, loss) in enumerate(template.segments(role, text or "")):
                    for name, v in zip(out, (c, number, k, segment, loss, valid), strict=True):
                        out[name].append(v)
                number, last = number + 1, role
            yield batch(_SEGMENTS, **out)

    return map_arrow(rows, run, "conv_id long, turn_no long, part long, segment string, loss boolean, valid boolean")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def digest(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Counts and digests of each conversation, parsed from its segments alone; one turn at a time is in memory."""
    rows = segments.repartition(shuffle_partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn_no", "part")

    def run(batches):
        state = None

        def close_turn():
            for role, text in template.turns("".join(state["open"])):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state["open"] = []

        def row():
            close_turn()
            return (state["conv"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["valid"])

        for b in batches:
            done = []
            for c, turn, segment, loss, valid in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn_no", "segment", "loss", "valid")), strict=True):
                if state is None or c != state["conv"]:
                    if state:
                        done.append(row())
                    state = {"conv": c, "turn": turn, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "valid": True, "open": []}
                if turn != state["turn"]:
                    close_turn()
                    state["turn"] = turn
                state["open"].append(segment)
                state["chars"] += len(segment)
                state["valid"] &= valid
                if loss:
                    plain = template.unescaped(segment)
                    state["loss_chars"] += len(plain)
                    state["loss"].update(plain.encode("utf-8", "surrogatepass"))
            yield batch(_DIGESTS, **dict(zip(_DIGESTS.names, zip(*done) if done else [[]] * len(_DIGESTS.names), strict=True)))
        if state:
            yield batch(_DIGESTS, **dict(zip(_DIGESTS.names, zip(*[row()]), strict=True)))

    return map_arrow(rows, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
