"""Chat formatting: every layout, and a reading of the output by plain Python."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat

LONG = "[INST] \\ <s> é " * 200_000
RECORDS = [
    ({"id": 1, "score": 0.5, "messages": [{"role": "system", "content": "s", "weight": 1}, {"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": None}]}, "messages", [("user", "")]),
    ({"messages": [{"role": None, "content": "x"}], "system": "be"}, "messages", [("system", "be"), ("", "x")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": ""}]}, "speakers", [("user", "q"), ("assistant", "r"), ("tool", "")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done", "history": [["h", "i"], ["j", None]]}, "instruction", [("user", "h"), ("assistant", "i"), ("user", "j"), ("assistant", ""), ("user", "do\n\nthis"), ("assistant", "done")]),
    ({"prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "chosen": "c", "rejected": "d"}, "preference", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p"}, "prompt_response", [("user", "p")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"prompt": "p", "question": "q"}, None, None), ({"id": 4}, None, None), ({}, None, None), (None, None, None),
    ({"prompt": LONG, "response": LONG}, "prompt_response", [("user", LONG), ("assistant", LONG)]),
]
SCHEMA = (
    "id long, score double, messages array<struct<role string, content string, weight int>>, conversations array<struct<from string, value string>>, instruction string, input string, output string, history array<array<string>>,"
    "prompt string, response string, completion string, chosen string, rejected string, question string, answer string, context string, system string"
)


def read(text, template):
    """The turns of a formatted text, read from left to right."""
    out, at = [], 0
    while at < len(text):
        assert text.startswith(template.start, at)
        fields, start = [], at + len(template.start)
        for mark in (template.middle, template.end):
            end = text.index(mark, start)
            body, plain, i = text[start:end], [], 0
            assert not any(c in body for c in template.controls)
            while i < len(body):
                i += body[i] == "\\"
                plain.append(body[i])
                i += 1
            fields.append(("".join(plain), body, start))
            start = end + len(mark)
        out.append((fields[0][0], fields[1][0], at, fields[1][2], fields[1][2] + len(fields[1][1])))
        at = start
    return out


def test_layouts(spark):
    rows = [(i, None if r is None else json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] * 2
    df = spark.createDataFrame(rows, "n int, j string").select("n", F.from_json("j", SCHEMA).alias("record"), *(F.lit("x").alias(c) for c in ("layout", "loss", "turn", "role", "turns", "a.b")))
    template = chat.Template()
    out = chat.format_chats(df)
    assert sorted(out.columns) == sorted(["n", "turn", "role", "turns", "a.b", "fingerprint", "layout", "formatted", "loss"])
    got = out.collect()
    assert len(got) == 2 * len(RECORDS)
    for r in got:
        _, layout, turns = RECORDS[r["n"]]
        assert r["layout"] == layout and len(r["fingerprint"]) == 64
        if turns is None:
            assert r["formatted"] is None and r["loss"] is None
            continue
        found = read(r["formatted"], template)
        assert [t[:2] for t in found] == turns
        assert [(s["turn"], s["start"], s["end"]) for s in r["loss"]] == [(i, a - at, b - at) for i, (role, _, at, a, b) in enumerate(found) if role == "assistant"]
    prints = {r["n"]: r["fingerprint"] for r in got}
    assert prints[7] == prints[16] and len({prints[i] for i in (0, 1, 2, 4, 5, 7, 8, 9, 10, 11, 12, 13)}) == 12 and prints[13] == prints[14]
    assert prints[0] == hashlib.sha256(b"messages[]\nmessages[].content\nmessages[].role").hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_types_that_no_layout_knows(spark):
    df = spark.createDataFrame([(1, "x")], "n int, prompt string").select("n", F.struct(F.col("n").alias("prompt"), F.lit("y").alias("messages")).alias("record"))
    (r,) = chat.format_chats(df).collect()
    assert r["layout"] == "prompt_response" and r["formatted"] == "<|im_start|>user<|im_sep|>1<|im_end|>\n"  # a text is no list of messages
    df = df.select("n", F.struct(F.lit(5).alias("prompt")).alias("record"))
    assert chat.format_chats(df).first()["formatted"] == "<|im_start|>user<|im_sep|>5<|im_end|>\n"
    assert chat.format_chats(df.select("n", F.struct("n").alias("record"))).first()["layout"] is None


def test_escapes(spark):
    rng = random.Random(6)
    bits = [*chat.CONTROLS, "\\", "<", "|", "[", "]", "/", "s>", "INST]", "\n", "é", "\U0001f600", "a", "im_end|>"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(3000)]
    rows = [(i, [(rng.choice(["user", "assistant", texts[-i]]), t), ("assistant", texts[-i - 1])]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n int, messages array<struct<role string, content string>>").select("n", F.struct("messages").alias("record"))
    template = chat.Template()
    out = chat.format_chats(df).withColumn("written", chat.written_turns(F.col("formatted"), template))
    out = out.select("n", "formatted", chat.read_turns(F.col("written"), template).alias("turns"), chat.read_masked(F.col("written"), F.col("loss"), template).alias("learned"))
    for r in out.collect():
        turns = rows[r["n"]][1]
        assert [tuple(t) for t in r["turns"]] == turns == [t[:2] for t in read(r["formatted"], template)]
        assert r["learned"] == "".join(t for role, t in turns if role == "assistant")
    with pytest.raises(ValueError):
        chat.Template(start="<plain>")


def test_query(spark, tmp_path):
    """Nulls, ties, repeated rows, odd roles, a long text and an empty table, against plain Python."""
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "user", None), (2, 0, "user", None), (2, 0, "assistant", "z"), (3, None, None, "first"), (3, 5, "human", "x"), (3, 2, "gpt\nrole", "y"), (None, 1, "user", "n"),
        (4, 0, "user", LONG), (4, 1, "assistant", LONG + "<|im_end|>"), (6, 0, "system", "s"), (6, 2, "assistant", "b"), (6, 1, "user", "c"), (7, 0, "user", ""), (7, 1, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("record", F.lit("x"))
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["conv_id"]: r for r in chat.op11_chat_format(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    assert set(found) == {r[0] for r in rows}
    for k, r in found.items():
        turns = [(role or "", text or "") for _, role, text in sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == k)]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] > sum(len(a) + len(b) for a, b in turns)
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert [r["conv_id"] for r in chat.op11_chat_format(spark, str(tmp_path / "none")).collect()] == [-7]
