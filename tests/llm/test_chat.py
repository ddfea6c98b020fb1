import hashlib
import random
import re

import pytest

from tallyspan.llm import chat
from tallyspan.llm.chat import INSTRUCTIONS, Reader, Template, chat_digests, chat_segments, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
SCRAPS = [*INSTRUCTIONS.controls, "\\", "\\\\", "[", "<", "]", " ", "\n", "a", "ж", "INST]", "[/", "<<", "<s", "</SYS>>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, template=INSTRUCTIONS):
    """Digests from the rows alone, by conversation; lengths from a plain escape by positions."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1e18 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        learned = "".join(x for _, r, x in turns if r in template.learned)
        state, valid, chars = "^", True, len(template.begin)
        for _, role, text in turns:
            valid &= state in template.follows.get(role, ())
            state = role if role != "^" else "other"
            marks = template.marks.get(role)
            pieces = [text] if marks else [role, text]
            chars += sum(map(len, marks or template.other)) + sum(len(p) + sum(p[i] == "\\" or any(p.startswith(c, i) for c in template.controls) for i in range(len(p))) for p in pieces)
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned), chars, valid and turns[-1][1] in template.ends)
    return out


def digests(frame, **how):
    return {r.conv_id: tuple(r)[1:] for r in chat_digests(frame, **how).collect()}


def test_texts_hold_no_control_and_come_back():
    random.seed(5)
    for _ in range(3000):
        text = "".join(random.choices(SCRAPS, k=random.randrange(9)))
        written = INSTRUCTIONS.escape(text)
        assert not any(c in written for c in INSTRUCTIONS.controls)
        assert unescape(written) == text


def test_a_formatted_conversation_reads_back_piece_by_piece():
    random.seed(6)
    for _ in range(300):
        turns = [(random.choice(["system", "user", "assistant", "tool", "", "^", "[ROLE] x"]), "".join(random.choices(SCRAPS, k=6))) for _ in range(random.randrange(6))]
        reader, got = Reader(INSTRUCTIONS), []
        whole = "".join(p for n, t in enumerate(turns) for p, _ in INSTRUCTIONS.segments(*t, n == 0))
        for at in range(0, len(whole), 7):  # borders of pieces anywhere
            got += reader.feed(whole[at : at + 7])
        assert got == turns and not reader.rest


def test_digests_equal_plain_python(spark):
    random.seed(7)
    rows = []
    for conv in [*range(40), None, -7]:
        for turn in range(random.randrange(1, 30)):
            role = random.choice(["user", "assistant"]) if random.random() < 0.2 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn, random.choice([role] * 9 + ["system", None, "tool", "^"]), random.choice([None, "", "".join(random.choices(SCRAPS, k=5)), "x" * 30])))
    rows += rows[:50] + [(3, None, "user", "no number"), (3, -5, "user", "below zero")]  # repeated rows, numbers out of the way
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert digests(frame) == want
    assert digests(frame, chunk=4) == want  # conversations of many runs
    assert {True, False} <= {w[-1] for w in want.values()}


def test_one_conversation_in_many_runs_is_formatted_in_many_tasks(spark):
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", f"turn {n}") for n in range(400)] + [(2, 0, "user", "hi"), (2, 1, "assistant", "ho")]
    segments = chat_segments(spark.createDataFrame(rows, SCHEMA), chunk=20)
    assert segments.where("conv_id = 1").select("chunk").distinct().count() == 20
    assert segments.where("not allowed").count() == 0
    text = "".join(r.text for r in segments.where("conv_id = 1").orderBy("chunk", "seq").collect())
    assert re.findall("<s>", text) == ["<s>"] and list(Reader(INSTRUCTIONS).feed(text)) == [(r, t) for c, _, r, t in rows if c == 1]
    assert digests(spark.createDataFrame(rows, SCHEMA), chunk=20)[1][-1] is True


def test_loss_lies_on_assistant_texts_only(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "[INST]"), (1, 3, "user", "v"), (1, 4, "assistant", "")]
    got = chat_segments(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert "".join(r.text for r in got) == "<s><<SYS>>\ns\n<</SYS>>\n\n[INST] u [/INST] [\\INST] </s>[INST] v [/INST]  </s>"
    assert [r.text for r in got if r.loss] == ["[\\INST]", ""]


def test_edge_cases(spark):
    assert chat_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word [INST] " * 200_000
    more = spark.createDataFrame([(1, 0, "user", long, "x", "y"), (1, 1, "assistant", long, "x", "y")], SCHEMA + ", chunk string, `a.b` string")
    assert digests(more) == brute([(1, 0, "user", long), (1, 1, "assistant", long)])


@pytest.mark.parametrize("change", [{"controls": ("<",)}, {"marks": {"user": ("[INST", " [/INST]")}}, {"marks": {"user": ("[INST] ", "plain")}}, {"marks": {"user": ("[INST] ", "INST] [/INST]")}}])
def test_templates_that_cannot_be_read_back_are_refused(change):
    own = {k: getattr(INSTRUCTIONS, k) for k in ("marks", "other", "follows", "ends", "learned", "controls", "begin")}
    with pytest.raises(ValueError):
        Template(**own | change)


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: tuple(r)[1:] for r in chat.op13_chat_format(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rows + [(-7, 0, "user", chat.CONTROL_TEXT), (-7, 1, "assistant", chat.CONTROL_TEXT)])
