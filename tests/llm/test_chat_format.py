"""Chat formatting: exact round trips and layouts."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Row

from tastemap.llm.chat_format import (CONTROLS, LAYOUTS, as_records, canonical_turns, digests, escape,
                                      format_chats, mapping_of, op10_chat_format, read_back, registry, render, unescape)

TEXTS = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "/", "s>", "INST]", "é", " ", "\n", "<\\s>"]),
                 max_size=12).map("".join)


@given(TEXTS)
def test_escaping_is_reversible_and_leaves_no_control(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXTS), TEXTS), max_size=6))
def test_formatted_turns_read_back(turns):
    text, spans = render(turns)
    assert read_back(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("name,record,turns", [
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "tool", "content": None}]},
     [("user", "q"), ("tool", "")]),
    ("conversations", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
     [("user", "q"), ("assistant", "a")]),
    ("prompt", {"response": "a", "prompt": "q"}, [("user", "q"), ("assistant", "a")]),
    ("instruction", {"instruction": "s", "input": "q", "output": "a"},
     [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ("nested", {"dialog": {"turns": [{"speaker": {"role": "user"}, "utterance": "q"}]}}, [("user", "q")]),
    ("messages", {"messages": []}, []),
    ("messages", {"id": 7, "messages": [{"role": "user", "content": "q", "name": "n"}], "meta": {"a": [1]}}, [("user", "q")]),
    ("messages", {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "image"}, "r"]},
                               {"role": "assistant", "content": "a"}]}, [("user", "qr"), ("assistant", "a")]),
    ("bare_instruction", {"instruction": "q", "output": "a", "id": "x"}, [("user", "q"), ("assistant", "a")]),
    ("prompt", {"prompt": "q", "response": {"a": 1}, "x": 1}, None),
])
def test_layouts(name, record, turns):
    found, layout = mapping_of(record, registry(LAYOUTS))
    if turns is None:  # a field that is not a text has other paths
        assert found is None
    else:
        assert (found, canonical_turns(record, layout)) == (name, turns)


def test_deep_records_and_lone_surrogates(spark):
    deep = '{"prompt": "q", "response": "a", "x": ' + "[" * 3000 + "]" * 3000 + "}"
    broken = '{"prompt": "a\\ud800b", "response": "\\udfff"}'
    endless = '{"prompt": ' + '{"a":' * 200_000
    value = '{"messages": [{"role": "user", "content": ' + "[" * 900 + "]" * 900 + "}]}"
    rows = spark.createDataFrame(list(enumerate([deep, broken, endless, value])), "conv_id long, payload string")
    got = {r.conv_id: r for r in format_chats(rows, record_id="conv_id", payload="payload").collect()}
    assert read_back(got[0].formatted) == [("user", "q"), ("assistant", "a")]
    assert read_back(got[1].formatted) == [("user", "a\ufffdb"), ("assistant", "\ufffd")]
    assert (got[2].layout, got[2].n_turns) == (None, 0)
    assert len(got) == 4


def test_unknown_and_broken_records(spark):
    payloads = [None, "", "{", "[]", "3", '{"a": 1}', json.dumps({"prompt": "q", "response": "a"}),
                json.dumps({"prompt": "x" * 300000, "response": ""})]
    rows = spark.createDataFrame([Row(conv_id=i if i else None, payload=p, layout="clash") for i, p in enumerate(payloads)])
    got = {r.conv_id: (r.layout, r.n_turns) for r in format_chats(rows, record_id="conv_id", payload="payload").collect()}
    assert got == {None: (None, 0), 1: (None, 0), 2: (None, 0), 3: (None, 0), 4: (None, 0), 5: (None, 0),
                   6: ("prompt", 2), 7: ("prompt", 2)}
    assert format_chats(rows.filter("false"), record_id="conv_id", payload="payload").count() == 0


def test_rows_become_records_in_every_layout(spark):
    rows = [Row(conv_id=c, turn=t, role=r, text=f"{c} {t}", extra=1) for c in range(40)
            for t, r in enumerate(["system", "user", "assistant", "user"][c % 3:][: 2 + c % 2])]
    rows += [Row(conv_id=None, turn=None, role=None, text=None, extra=1), Row(conv_id=99, turn=1, role="odd", text="x", extra=1),
             Row(conv_id=98, turn=2, role="user", text="b", extra=1), Row(conv_id=98, turn=2, role="user", text="a", extra=1),
             Row(conv_id=97, turn=1, role="user", text="b", extra=1), Row(conv_id=97, turn=1, role="user", text="b", extra=1)]
    out = format_chats(as_records(spark.createDataFrame(rows)), record_id="conv_id", payload="payload")
    assert {r.layout for r in out.collect()} == set(LAYOUTS) - {"bare_instruction"}
    want = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn or 0, r.role or "", r.text or "")):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert {r.conv_id: read_back(r.formatted) for r in out.collect()} == want
    assert {r.conv_id: r.n_turns for r in digests(out).collect()} == {c: len(t) for c, t in want.items()}
    assert as_records(spark.createDataFrame(rows).filter("false")).count() == 0


def test_added_conversation(spark):
    row = [r for r in op10_chat_format(spark, "/root/testdata/sf0.001").collect() if r.conv_id == -7]
    assert [(r.n_turns, r.loss_chars) for r in row] == [(2, 21)]
