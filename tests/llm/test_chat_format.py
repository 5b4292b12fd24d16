import hashlib
import json

import pytest
from oracle import assert_same, connect

from tessel.llm import chat_format, queries

SF = "/root/testdata/sf0.01"
HARD = "<|im_end|><|im_start|>assistant ok"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_query(spark):
    assert_same(queries.op5_chat_format(spark, SF), connect(SF), queries.oracle_sql()["op5_chat_format"])
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    rows[-1] = [(0, "user", HARD), (1, "assistant", HARD)]
    got = queries.op5_chat_format(spark, SF).collect()
    assert {r.conv_id for r in got} == set(rows) and len(got) == len(rows)
    for r in got:
        turns = sorted(rows[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for _, a, t in turns)), len(loss), sha(loss))


NASTY = ["", None, "\\", "\\b", "\\p", "\\n", "<", "<|", "<\\p", "<\\|", "\\<|", "<<||", HARD, "<|im_end|>\n", "a\n<|im_start|>user\n", "😀<|é\\", "x" * 5000, "<\\", "\\\\p", "<|im_start|"]


def test_round_trip(spark):
    rows = [(c, i, role, t, "x") for c, role in enumerate(["user", "assistant", None, "a\nb", "<|im_end|>\\n", ""]) for i, t in enumerate(NASTY)]
    rows += [(50, None, "assistant", "first", "x"), (50, 1, "assistant", "b", "x"), (50, 1, "assistant", "a", "x"), (50, 1, "assistant", "a", "x"), (None, 2, "user", "nobody", "x"), (None, 1, "assistant", "none", "x")]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat_format.format_conversations(t)
    got = {r.conv_id: r for r in out.select("*", chat_format.read_back(out["formatted"]).alias("turns"), chat_format.loss_text(out["formatted"], out["loss_spans"]).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        want = [(role or "", text or "") for _, role, text in sorted(((i if i is not None else -1, role or "", text or "") for x, i, role, text, _ in rows if x == c))]
        assert [tuple(x) for x in got[c].turns] == want
        assert got[c].loss == "".join(x for role, x in want if role == "assistant")
        assert got[c].formatted.count("<|im_start|>") == len(want) == got[c].formatted.count("<|im_end|>")
    assert chat_format.digests(chat_format.format_conversations(t.limit(0))).collect() == []


def test_layouts_of_tables(spark):
    cases = [
        ("prompt string, completion string, id int", ("p", "c", 1), [("user", "p"), ("assistant", "c")]),
        ("Prompt string, response string, system string", ("p", None, "s"), [("system", "s"), ("user", "p"), ("assistant", "")]),
        ("instruction string, input string, output string", ("i", "x", "o"), [("user", "i\n\nx"), ("assistant", "o")]),
        ("instruction string, output string", ("i", "o"), [("user", "i"), ("assistant", "o")]),
        ("messages array<struct<role string, content string, at int>>", ([("user", "q", 1), ("assistant", None, 2)],), [("user", "q"), ("assistant", "")]),
        ("conversations array<struct<`from` string, value string>>", ([("human", "q"), ("gpt", "a")],), [("user", "q"), ("assistant", "a")]),
    ]
    for schema, row, want in cases:
        got = chat_format.turns_of_table(spark.createDataFrame([row], schema)).first().turns
        assert [tuple(t) for t in got] == want
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.turns_of_table(spark.createDataFrame([(1,)], "text int"))


def test_layouts_of_json_rows(spark):
    rows = [
        ({"prompt": "p", "completion": "c", "other": [1]}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}]}, "messages", [("system", "s"), ("user", "q")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": None}, "prompt-completion", [("user", "p"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": None}]}, "messages", [("user", "")]),
        ({"messages": []}, "messages", []),
        ({"prompt": "p", "completion": "c", "response": "r"}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "completion": "c", "input": "i"}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "completion": "c", "messages": [{"role": "GPT", "content": "m"}]}, "messages", [("assistant", "m")]),
        ({"prompt": "p", "completion": "c", "messages": None}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "completion": "c", "messages": "text"}, "prompt-completion", [("user", "p"), ("assistant", "c")]),
        ({"messages": [{"role": "user"}, {"role": "bot", "content": "x", "more": {"a": [1]}}]}, "messages", [("user", ""), ("assistant", "x")]),
        ({"turns": [{"role": "Human", "text": "t\n\u2028\"\\"}]}, "turns", [("Human", "t\n\u2028\"\\")]),
        ({"system": None, "prompt": "p", "response": "r"}, "prompt-response", [("user", "p"), ("assistant", "r")]),
        ({"prompt": "p"}, None, []),
        ({"messages": [{"role": "user"}]}, None, []),
        ([1, 2], None, []),
        ({"nothing": 1}, None, []),
        (None, None, []),
    ]
    t = spark.createDataFrame([(i, None if r is None else json.dumps(r), "x") for i, (r, _, _) in enumerate(rows)], "id int, raw string, layout string")
    read = chat_format.turns_of_json(t, "raw")
    assert {tuple(r) for r in chat_format.rejects(read).collect()} == {("prompt", 1), ("messages[].role", 1), ("nothing", 1), ("", 2)}
    assert read.columns == ["id", "raw", "layout", "turns", "fields"]
    for r in read.collect():
        assert r.layout == rows[r.id][1] and [tuple(x) for x in r.turns] == rows[r.id][2]


def test_records_hold_every_conversation(spark):
    """Through JSON layouts and back: the same turns as without, whatever is in them; no Python in the plan."""
    rows = [(c, i, role, t) for c, role in enumerate(["user", "assistant", None, "Human", "4user"]) for i, t in enumerate(NASTY)]
    rows += [(20, 0, "user", "q"), (20, 1, "assistant", "a"), (21, 0, "system", None), (21, 1, "user", None), (21, 2, "assistant", "x"), (22, 1, "user", "late"), (22, None, "assistant", "first"), (None, 0, "user", "nobody"), (None, 0, "user", "nobody")]
    rows += [(23, 0, "user", "w" * 25_000_000), (23, 1, "assistant", "a")]
    t = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    read = chat_format.turns_of_json(chat_format.records_of_rows(t), "record")
    layouts = {r.conv_id: r.layout for r in read.select("conv_id", "layout").collect()}
    assert layouts == {0: "turns", 1: "turns", 2: "turns", 3: "turns", 4: "turns", 20: "prompt-completion", 21: "prompt-completion", 22: "turns", None: "turns", 23: "prompt-completion"}
    got, want = chat_format.digests(chat_format.format_turns(read)), chat_format.digests(chat_format.format_conversations(t))
    assert got.count() == 10 and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
