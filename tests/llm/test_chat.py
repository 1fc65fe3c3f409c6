import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import chat
from tidemark.llm.queries import op11_chat_formatting

MESSAGES = "conv_id long, turn long, role string, text string, formatted string, loss string, place string, `all` string, held string"


def read_back(frame):
    out = chat.format_conversations(frame)
    return out.select("*", chat.turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()


def slow(rows):
    """conv_id -> (turns, text to learn), by the contract."""
    out = {}
    for c, t, r, x in sorted(rows, key=lambda m: (m[1] is not None, m[1] or 0, m[2] or "")):
        turns, learned = out.setdefault(c, ([], []))
        turns.append((r or "", x or ""))
        if r == "assistant":
            learned.append(x or "")
    return {c: (turns, "".join(learned)) for c, (turns, learned) in out.items()}


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], MESSAGES).repartition(3)


def test_everything_comes_back(spark):
    rng = random.Random(4)
    bits = [*chat.Template().controls(), "<", "[", "/", "\\", "s>", "INST]", "IMG]", "$1", "\n", " ", "é", "😀", "﻿", "\0", "x"]
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "tool", "[/ROLE]</s>", "a\nb", "", None]), "".join(rng.choices(bits, k=rng.randint(0, 12))))
        for c in range(120) for t in range(rng.randint(1, 6))
    ]
    rows += [(900, 0, "assistant", None), (900, None, "user", ""), (None, 1, "user", "x"), (None, 2, "assistant", "y")]
    rows += [(901, 0, "user", "\\" * 5000 + "<" * 5000), (901, 1, "assistant", "<" + "\\" * 300 + "s>" + "long " * 40_000)]
    got, want = {r.conv_id: r for r in read_back(frame_of(spark, rows))}, slow(rows)
    assert got.keys() == want.keys()
    for c, (turns, learned) in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns and got[c].n_turns == len(turns)
        assert got[c].learned == learned
        for span in got[c].loss:
            assert got[c].formatted[span.end :].startswith(chat.END)


def test_repeated_rows_and_ties_stay_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "user", "A")]
    (row,) = read_back(frame_of(spark, rows))
    assert [(t.role, t.text) for t in row.turns] == [("assistant", "b"), ("user", "A"), ("user", "a"), ("user", "a")]
    assert read_back(frame_of(spark, rows).limit(0)) == []


def test_one_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(6000)]
    (row,) = read_back(frame_of(spark, rows))
    assert row.n_turns == 6000 and row.learned == "".join(f"turn {t} </s>" for t in range(1, 6000, 2))


def test_only_control_strings_are_escaped(spark):
    texts = ["a < b and c[1] \\ <s >", "</s>", "<\\s>", "[IMG]", "[ INST]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.escape(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a < b and c[1] \\ <s >", "<\\/s>", "<\\\\s>", "[\\IMG]", "[ INST]"]


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return kind, text, ref, width, height, seconds, pages


def test_parts_become_ordered_placeholders(spark):
    rows = [
        (1, 0, "user", [part("text", "see <"), part("text", "s> "), part("image", None, "i1", 57, 28), part("text", " and [IMG]"), part("document", None, "d", pages=3)]),
        (1, 1, "assistant", [part("audio", "ignored", "a", seconds=0.5), part("text", "ok"), part(None, "gone", "n"), part("video", None, "v"), None]),
        (1, 2, "user", None),
        (1, 3, "user", []),
        (1, 4, "user", [part("image", ref="i2"), part("audio", seconds=float("nan")), part("document", pages=None)]),
    ]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", chat.PARTS)])
    (row,) = read_back(spark.createDataFrame(rows, schema))
    assert row.formatted == (
        "<s>[INST]see <\\s> [IMG] and [\\IMG][DOC][/INST][AUDIO]ok[FILE][FILE]</s>[INST][/INST][INST][/INST][INST][IMG][AUDIO][DOC][/INST]"
    )
    got = [(a.place, a.kind, a.ref, a.tokens) for a in row.attachments]
    assert got == [
        (0, "image", "i1", 3), (0, "document", "d", 2304), (1, "audio", "a", 13), (1, None, "n", 0), (1, "video", "v", 0),
        (4, "image", "i2", 576), (4, "audio", None, 750), (4, "document", None, 768),
    ]
    assert row.attachment_tokens == sum(a.tokens for a in row.attachments)
    assert row.learned == "[AUDIO]ok[FILE][FILE]"


@pytest.mark.parametrize("fields", [("type", "text"), ("type", "text", "ref", "extra")])
def test_part_structs_may_lack_fields(spark, fields):
    schema = ", ".join(f"{f}:string" for f in fields)
    frame = spark.createDataFrame([(1, 0, "user", [("image", "x", "r", "e")[: len(fields)]])], f"conv_id long, turn int, role string, text array<struct<{schema}>>")
    (row,) = read_back(frame)
    assert row.formatted == "<s>[INST][IMG][/INST]" and row.attachment_tokens == 576


def test_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    want = slow(rows)
    got = {r.conv_id: r for r in op11_chat_formatting(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got.keys() == want.keys()
    for c, (turns, learned) in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))


def test_the_plan_has_no_python(spark, sf):
    plan = op11_chat_formatting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
