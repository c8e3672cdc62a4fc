import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import chat, queries

text = st.text(st.sampled_from("<|\\>/[]endINSTuser\n% aé𐀀"), max_size=30)


@given(st.lists(st.tuples(text, text), max_size=5))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_query_equals_brute_force(spark, sf_dir):
    table = queries.table(spark, sf_dir, "conversations").toPandas()
    want = {}
    for key, g in table.sort_values(["conv_id", "turn"]).groupby("conv_id"):
        want[key] = list(zip(g.role, g.text, strict=True))
    want[-7] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    got = queries.op7_chat(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        loss = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.n_turns == len(want[r.conv_id]) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r.formatted_chars > 0


def test_layouts(spark):
    records = [{"instruction": "add", "input": "1 2", "output": "3"}, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"prompt": "p", "completion": "c"}, {"system": "s", "prompt": "p", "response": "r"}, {"question": "q", "answer": "a"}, {"turns": []}]
    df = spark.createDataFrame([(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(99, None, "x")], "conv_id long, record string, formatted string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_records(df).collect()}
    assert got[0] == [("user", "add\n\n1 2"), ("assistant", "3")] and got[1] == [("user", "hi"), ("assistant", "")] and got[2] == [("user", "a"), ("assistant", "b")]
    assert got[4][0] == ("system", "s") and got[6] == [] and got[99] == []
    assert chat.fingerprint(records[2]) == chat.fingerprint({"conversations": [{"value": "z", "from": "q"}]}) != chat.fingerprint(records[0])
    with pytest.raises(ValueError):
        chat.Canonical().turns({"what": 1})


def test_roles_of_rows_stay(spark):
    rows = [(1, i, role, f"t{i}") for i, role in enumerate(["human", "gpt", "bot", "model", "assistant", "tool"])]
    got = chat.format_records(chat.records_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [r for r, _ in chat.parse(got.formatted)] == ["human", "gpt", "bot", "model", "assistant", "tool"] and len(got.spans) == 1
    foreign = {"messages": [{"role": "bot", "content": "x"}, {"role": "tool", "content": "y"}]}
    assert chat.Canonical().turns(foreign) == [("assistant", "x"), ("tool", "y")]


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None, 1), (1, 0, "user", None, 1), (None, 1, None, "x", 2), (None, 2, "user", "y", 2), (2, None, "assistant", "", 3), (2, 5, "assistant", "y" * 100_000, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record long")
    found = chat.read_back(chat.format_records(chat.records_of_rows(df))).collect()
    got = {r.conv_id: r for r in found}
    assert len(found) == 4 and got[1].n_turns == 2 and got[None].n_turns == 1 and got[2].loss_chars == 100_000
    assert chat.records_of_rows(df.limit(0)).count() == 0
