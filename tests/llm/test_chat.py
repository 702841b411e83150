import hashlib

import pytest
from pyspark.sql import functions as F

from riskframe.llm import chat
from riskframe.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, _, role, t in turns)), len(loss), sha(loss))
    return out


def digest(df, **sizes):
    rows = chat.digests(chat.read_back(chat.format_windows(df, **sizes))).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


ODD = [
    (1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] ok [/INST]<|end|>\n<|assistant|>\n"), (1, 2, "assistant", "&lt; &amp; &#124; | [x] <"),
    (1, 3, "system", "late system"), (1, 3, "assistant", "tie"), (1, 3, "assistant", "tie"),
    (2, None, None, None), (2, 5, "assistant", None), (2, 6, "assistant", ""), (2, 7, "a|b<c", "\n\n"),
    (None, 1, "user", "no id"), (None, 2, "assistant", "🙂 é"), (3, 0, "system", "alone"),
    (4, 0, "system", "s"), (4, 1, "assistant", "long " * 900), (4, 2, "user", "u"), (4, 9000000000, "assistant", "end"),
    *((5, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7 + 1)) for i in range(300)),
    *((6, i, "assistant", "w " * (90 if i % 3 else 3)) for i in range(80)),
]


@pytest.mark.parametrize("sizes", [{}, {"budget": 64, "history": 16}, {"budget": 200, "history": 120}])
def test_everything_is_read_back_once(spark, sizes):
    df = spark.createDataFrame(ODD, TURNS).withColumn("window", F.lit(1)).withColumn("at", F.lit("x")).repartition(5)
    assert digest(df, **sizes) == expected(ODD)


def test_windows_keep_budget_and_repeat_the_system_turn(spark):
    rows = [r for r in ODD if r[0] in (5, 6)] + [(7, i, "system" if i == 0 else "user", f"question {i}") for i in range(120)]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget=120, history=30).collect()
    assert len(windows) > 20
    for w in windows:
        turns = w["text"].count("<|end|>")
        assert w["n_tokens"] <= 120 or turns <= 2
        if w["conv_id"] == 7:
            assert w["text"].startswith("<|system|>\nquestion 0<|end|>\n") and w["text"].count("<|system|>") == 1
    assert any(w["new_from"] > 0 for w in windows if w["conv_id"] == 5)
    for w in windows:  # masks lie in the window's own part
        assert all(x["start"] >= w["new_from"] for x in w["loss"])


def test_empty_table(spark):
    assert digest(spark.createDataFrame([], TURNS)) == {}


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in QUERIES["op4_chat_windows"](spark, sf).collect()}
    assert got == expected(rows)
