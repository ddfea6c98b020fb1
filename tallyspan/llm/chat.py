"""Chat formatting: a finite-state machine over roles checks the order of turns and emits text segments with loss flags.

The states are the start and the roles; Template says which role may follow which, in which a conversation may end, how
each turn is marked, and whose texts are learned. A turn that may not follow is written all the same and noted, so that
nothing is lost. Control strings inside texts and role names are escaped so that none is left in them, and read back
exactly.

A conversation is cut into runs of CHUNK turn numbers, each a sorted stream in one task: the state before a run is the
role of the last turn before it, so a conversation that holds a third of all rows is formatted in many tasks. Only the
digests of a conversation have to take its segments in order; those of one run are digested where they are written, the
others are streamed through one task per conversation, one turn in memory at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspan.llm.common import table

#: Turn numbers of a run, and segments of a batch that is handed on.
CHUNK, BATCH = 4096, 2048
START = "^"
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """marks: role to (opening, closing); other: (opening, end of the name, closing) for roles without marks of their own.

    follows: role to the roles, or START, that it may come after; ends: roles a conversation may end with; learned:
    roles whose texts are under the loss mask; controls: the strings that must not stand in a text; begin: what a
    conversation begins with. Refused where a control could arise across the border of a mark and a text.
    """

    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    learned: tuple[str, ...]
    controls: tuple[str, ...]
    begin: str = ""
    escaped: re.Pattern = field(init=False, compare=False)
    opening: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        if any(len(c) < 2 or ESCAPE in c for c in self.controls):
            raise ValueError("a control has two characters at least and no escape character")
        before = [*(o for o, _ in self.marks.values()), *self.other[:2]]
        after = [*(c for _, c in self.marks.values()), *self.other[1:]]
        halves = [(c[:n], c[n:]) for c in self.controls for n in range(1, len(c))]
        if any(m.endswith(p) for m in before for p, _ in halves) or any(m.startswith(q) or q.startswith(m) for m in after for _, q in halves):
            raise ValueError("a mark and a text could make up a control")
        if any(not any(c in m for c in self.controls) for m in after):
            raise ValueError("what ends a text holds a control")
        openings = [o for o, _ in self.marks.values()] + [self.other[0]]
        if any(a != b and b.startswith(a) for a in openings for b in openings) or len(set(openings)) < len(openings) or "" in openings:
            raise ValueError("no opening is the beginning of another")
        one_of = "|".join(map(re.escape, self.controls))
        object.__setattr__(self, "escaped", re.compile(rf"\\|(?={one_of}).", re.DOTALL))
        object.__setattr__(self, "opening", re.compile("|".join(map(re.escape, openings))))

    def escape(self, text: str) -> str:
        """Each escape character and each first character of a control gets an escape character behind it."""
        return self.escaped.sub(lambda m: m[0] + ESCAPE, text)

    def segments(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        """(text, under the loss mask) of a turn."""
        if role in self.marks:
            opening, closing = self.marks[role]
        else:
            opening, closing = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [((self.begin if first else "") + opening, False), (self.escape(text), role in self.learned), (closing, False)]

    def allows(self, state: str, role: str) -> bool:
        return state in self.follows.get(role, ())


def unescape(text: str) -> str:
    """Of n escape characters in a row, n // 2 are the text's own."""
    return re.sub(r"\\(\\?)", r"\1", text)


class Reader:
    """Reads a formatted conversation back, piece by piece; keeps no more than the turn that is not yet closed."""

    def __init__(self, template: Template):
        self.template, self.rest, self.begun = template, "", not template.begin
        self.roles = {o: (r, c) for r, (o, c) in template.marks.items()}

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        t = self.template
        self.rest += piece
        if not self.begun and self.rest.startswith(t.begin):
            self.rest, self.begun = self.rest[len(t.begin) :], True
        while self.begun and (opening := t.opening.match(self.rest)):
            start = opening.end()
            role, closing = self.roles.get(opening[0], (None, t.other[2]))
            if role is None:
                name_end = self.rest.find(t.other[1], start)
                if name_end < 0:
                    return
                role, start = unescape(self.rest[start:name_end]), name_end + len(t.other[1])
            end = self.rest.find(closing, start)
            if end < 0:
                return
            text, self.rest = unescape(self.rest[start:end]), self.rest[end + len(closing) :]
            yield role, text


#: The marks and controls of a usual instruction format.
INSTRUCTIONS = Template(
    marks={"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")},
    other=("[ROLE] ", " [AS] ", " [/ROLE]"),
    follows={"system": (START,), "user": (START, "system", "assistant"), "assistant": ("user",)},
    ends=("user", "assistant"),
    learned=("assistant",),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[AS]", "[/ROLE]"),
    begin="<s>",
)

SEGMENTS = "conv_id long, chunk long, seq long, text string, loss boolean, allowed boolean, last string"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _rows(names: list[str], types: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t.split()[1]]) for c, t in zip(columns, types.split(", "))], names)


def _state(role: str) -> str:
    """The state after a turn of a role; a role called like the start is another state."""
    return role if role != START else f"role {START}"


def _format(template: Template):
    """Rows sorted by conversation, run and turn: their segments; last is the turn's role, on its last segment only."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(batches):
        run_of, state, seq, out = None, START, 0, []
        for batch in batches:
            for conv, chunk, role, text, before in zip(*(batch[c].to_pylist() for c in ("conv_id", "chunk", "role", "text", "before"))):
                if run_of != (conv, chunk):
                    run_of, state, seq = (conv, chunk), START if before is None else _state(before[1:]), 0
                allowed = template.allows(state, role)
                parts = template.segments(role, text, state == START)
                for n, (piece, loss) in enumerate(parts):
                    out.append((conv, chunk, seq, piece, loss, allowed, role if n == len(parts) - 1 else None))
                    seq += 1
                state = _state(role)
                if len(out) >= BATCH:
                    yield _rows(names, SEGMENTS, out)
                    out = []
        if out:
            yield _rows(names, SEGMENTS, out)

    return run


def _digest(template: Template):
    """Segments in order: per conversation, what is read back from its formatted text and from the loss flags."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def run(batches):
        conv, begun, out = None, False, []

        def finished():
            if reader.rest:
                raise ValueError(f"conversation {conv} cannot be read back")
            return conv, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars, valid and last in template.ends

        for batch in batches:
            for c, piece, loss, allowed, role in zip(*(batch[x].to_pylist() for x in ("conv_id", "text", "loss", "allowed", "last"))):
                if not begun or c != conv:
                    if begun:
                        out.append(finished())
                    conv, begun, reader, turns, learned = c, True, Reader(template), hashlib.sha256(), hashlib.sha256()
                    n, loss_chars, chars, valid, last = 0, 0, 0, True, None
                chars, valid, last = chars + len(piece), valid and allowed, role if role is not None else last
                if loss:
                    own = unescape(piece)
                    loss_chars += len(own)
                    learned.update(own.encode())
                for who, text in reader.feed(piece):
                    n += 1
                    turns.update(f"{who}\n{text}\n".encode())
            if len(out) >= BATCH:
                yield _rows(names, DIGESTS, out)
                out = []
        if begun:
            out.append(finished())
        yield _rows(names, DIGESTS, out)

    return run


def _runs(turns: DataFrame, chunk: int) -> DataFrame:
    """Turns with their run, what came before it (a mark and the role; null at the start of a conversation), and whether the conversation has more than one run."""
    number = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("chunk", F.greatest(F.floor(number / chunk), F.lit(0).cast("long")))
    many = own.groupBy(F.col("conv_id").alias("id")).agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low < high").select("id")
    ends = own.join(many, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi").groupBy("conv_id", "chunk").agg(F.max_by("role", F.struct("turn", "role", "text")).alias("role"))
    before = F.lag(F.concat(F.lit("="), F.col("role"))).over(Window.partitionBy("conv_id").orderBy("chunk"))  # a row per run
    heads = ends.select(F.col("conv_id").alias("id"), F.col("chunk").alias("_chunk"), before.alias("before"), F.lit(True).alias("split"))
    joined = own.join(heads, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("chunk") == F.col("_chunk")), "left")
    return joined.select("conv_id", "chunk", "turn", "role", "text", "before", F.coalesce("split", F.lit(False)).alias("split"))


def _segments(rows: DataFrame, template: Template) -> DataFrame:
    dealt = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", "text")
    return dealt.select("conv_id", "chunk", "role", "text", "before").mapInArrow(_format(template), SEGMENTS)


def chat_segments(turns: DataFrame, template: Template = INSTRUCTIONS, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, seq, text, loss, allowed, last): the formatted conversations, segment by segment.

    A conversation's text is that of its segments by (chunk, seq). Turns come by number, a null number first; turns of
    one number by role and text; rows that repeat a turn are turns of their own. A null text is empty, a null role is
    the role without a name, a null conv_id is a conversation. allowed is false for a turn that may not follow the one
    before; last is the role, on a turn's last segment. Other columns are not read; an empty table gives no rows.
    """
    return _segments(_runs(turns, chunk), template)


def chat_digests(turns: DataFrame, template: Template = INSTRUCTIONS, chunk: int = CHUNK) -> DataFrame:
    """Per conversation what its formatted text says when it is read back (DIGESTS); edge cases as in chat_segments.

    valid: every turn may follow the one before and the last one may end a conversation.
    """
    rows = _runs(turns, chunk)
    whole = _segments(rows.where("not split"), template).mapInArrow(_digest(template), DIGESTS)
    parts = _segments(rows.where("split"), template).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "seq")
    return whole.unionByName(parts.mapInArrow(_digest(template), DIGESTS))


#: A conversation that says the controls of the template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op13_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_digests(turns.unionByName(said))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[AS\]')) + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 21 + length(role) END AS chars,
    coalesce(lag(role) OVER w, '^') AS state, lead(role) OVER w IS NULL AS ends
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN state = '^' WHEN 'user' THEN state IN ('^', 'system', 'assistant') WHEN 'assistant' THEN state = 'user' ELSE false END AND (NOT ends OR role IN ('user', 'assistant'))) AS valid
FROM marked GROUP BY conv_id
"""
