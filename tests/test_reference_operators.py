"""Converters, formatters, validators, scans, sinks and streams, by fixtures and by a plain row version."""

import gzip
import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright import cli
from tracewright.functions import jsonx, roles
from tracewright.operators import conversation, formats, validate
from tracewright.plans import adapters, catalog, engine
from tracewright.schema import FIELDS, INTERACTION, MESSAGES
from tracewright.sources import scans, storage
from tracewright.streaming import sessions


def made(record, source, **options):
    return adapters.converted(record, source, **options)


def turns(interaction):
    return [(m["role"], m["content"]) for m in interaction.messages]


def roles_of(interaction):
    return [m["role"] for m in interaction.messages]


# converters


def test_langgraph():
    state = {"messages": [{"role": "human", "content": "Summarize"}, {"type": "ai", "content": "Summary"}], "topic": "x"}
    (m,) = made({"state": state, "config": {"configurable": {"thread_id": 7}}}, "langgraph")
    assert turns(m) == [("user", "Summarize"), ("assistant", "Summary")] and m.session == "7" and m.views["extra"] == {"state": {"topic": "x"}}
    nested = {"state": {"a": {"messages": [{"role": "user", "content": "1"}]}, "b": {"chat_history": {"role": "user", "content": "2"}}}}
    assert [c for _, c in turns(made(nested, "langgraph")[0])] == ["1", "2"]
    events = [["updates", {"n": {"messages": [{"role": "user", "content": "q"}]}}], {"type": "messages", "data": {"content": "chunk"}}, {"mode": "values", "data": {"messages": [{"role": "user", "content": "q"}, {"content": "a"}]}}]
    (m,) = made({"events": events}, "langgraph")
    assert turns(m) == [("user", "q"), ("assistant", "a")] and len(m.spans) == 3
    assert turns(made({"events": events[:1]}, "langgraph", leak=True)[0]) == []
    assert "chunk" in [c for _, c in turns(made({"events": events}, "langgraph", chunks=True)[0])]


def test_crewai():
    (m,) = made({"messages": [{"role": "user", "content": "go"}], "response": "done", "agent": {"role": "R", "tools": [{"name": "t"}, "s"]}, "task": {"id": 1}, "iterations": 2, "crew_id": 5}, "crewai")
    assert turns(m) == [("user", "go"), ("assistant", "done")] and m.session == "5" and m.views["agent"]["name"] == "R" and m.views["instantiation"]["iterations"] == 2
    (m,) = made({"tool_name": "search", "tool_input": '{"q": 1}', "tool_result": None, "tool_call_id": 3}, "crewai")
    assert roles_of(m) == ["tool_call", "tool_response"] and m.messages[0]["tool_args"] == {"q": 1} and m.messages[0]["tool_call_id"] == "3"
    (m,) = made({"tool_name": "search", "tool_input": {}, "tool_call_id": 3}, "crewai", leak="_own")
    assert m.messages[0]["tool_args"] == {"_own": {"tool_call_id": "3"}}
    assert roles_of(made({"event": {"type": "ToolUsageFinished", "tool_name": "x", "output": "y"}}, "crewai")[0]) == ["tool_call", "tool_response"]
    (m,) = made({"event": {"event_type": "CrewKickoff", "input": "a", "output": "b"}}, "crewai")
    assert turns(m) == [("user", "a"), ("assistant", "b")] and m.spans[0][0] == "crewai.event"
    (m,) = made({"kickoff_output": {"raw": "final", "tasks_output": [{"a": 1}, "t"]}}, "crewai")
    assert turns(m) == [("assistant", "final")] and m.views["extra"]["tasks_output"] == [{"a": 1}, "t"]


def test_agno():
    call = {"id": "c1", "type": "function", "function": {"name": "f", "arguments": '{"x": 1}'}}
    transcript = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "", "tool_calls": [call]}, {"role": "tool", "content": "r", "tool_call_id": "c1", "name": "f"}, {"role": "assistant", "content": "a"}]
    (m,) = made({"run_id": "r", "messages": transcript, "tools": [{"tool_name": "f", "tool_args": {}, "result": "r"}]}, "agno")
    assert roles_of(m) == ["user", "assistant", "tool_call", "tool_response", "assistant"] and m.messages[2]["tool_args"] == {"x": 1} and m.messages[3]["tool_call_id"] == "c1" and m.session == "r"
    (m,) = made({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "tools": [{"tool_name": "f", "tool_args": {"a": 1}, "result": "r"}]}, "agno")
    assert roles_of(m) == ["user", "tool_call", "tool_response", "assistant"]
    assert turns(made({"messages": [{"role": "user", "content": "q"}], "content": "ignored"}, "agno")[0]) == [("user", "q")]
    two = made({"session_id": "s", "agent_name": "n", "runs": [{"content": "1"}, {"content": "2", "session_id": "own"}]}, "agno")
    assert [m.session for m in two] == ["s", "own"] and two[0].metadata["agent_name"] == "n"
    assert made({"trace": {"id": "t1", "spans": []}}, "agno")[0].views["trace_id"] == "t1"
    events = [{"event": "RunChunk", "message": {"content": "c"}}, {"event": "ToolDone", "tool_name": "f", "args": {}, "result": 1, "session_id": "z"}, {"event": "RunCompleted", "content": "end"}]
    (m,) = made({"events": events}, "agno_events")
    assert roles_of(m) == ["tool_call", "tool_response", "assistant"] and m.session == "z" and len(m.spans) == 3


def test_autogen():
    history = [{"role": "system", "content": "s", "name": "u"}, {"role": "assistant", "name": "User", "content": "q"}, {"role": "user", "name": "Bot", "content": "a"}]
    assert turns(made({"chat_history": history}, "ag2")[0]) == [("system", "s"), ("user", "q"), ("assistant", "a")]
    items = [{"source": "user", "content": "q"}, {"type": "ToolCallRequestEvent", "source": "b", "content": [{"id": "1", "name": "f", "arguments": '{"a": 2}'}, {"name": "g"}]}, {"type": "ToolCallExecutionEvent", "content": [{"call_id": "1", "name": "f", "content": {"content": "r"}}]}]
    (m,) = made({"messages": items, "stop_reason": "done"}, "autogen")
    assert roles_of(m) == ["user", "tool_call", "tool_call", "tool_response"] and m.messages[2]["tool_call_id"] == "call_unknown" and m.messages[3]["content"] == "r"
    (m,) = made({"events": [{"type": "StreamingChunk", "content": "hi"}, {"type": "x", "content": {"history": history}}, {"type": "y", "content": 3}]}, "autogen")
    assert turns(m) == [("assistant", "hi"), ("system", "s"), ("user", "q"), ("assistant", "a")] and len(m.spans) == 2


def test_atomic_and_pydantic():
    (m,) = made({"history": [{"role": "user", "content": '{"chat_message": "hi"}'}, {"content": {"only": "text"}}, {"role": "assistant", "content": ""}, {"role": "assistant", "content": {"a": "1", "b": "2"}}]}, "atomic")
    assert turns(m) == [("user", "hi"), ("user", "text"), ("assistant", '{"a": "1", "b": "2"}')]
    assert turns(made({"response": {"answer": "x"}, "input": "q"}, "atomic_agents")[0]) == [("user", "q"), ("assistant", "x")]
    assert turns(made({"event_type": "run", "output": "o"}, "atomic_agents")[0]) == [("assistant", "o")]
    (m,) = made({"user_message": "u", "system": "s", "tool_calls": [{"name": "f", "args": {"k": 1}, "result": {"text": "r"}}, {"name": "f", "args": {}, "result": "r2"}], "final_answer": "z"}, "atomic_agents")
    assert roles_of(m) == ["system", "user", "tool_call", "tool_response", "tool_call", "tool_response", "assistant"]
    assert m.metadata["tool_schemas"][0]["function"]["parameters"]["required"] == ["k"] and len(m.metadata["tool_schemas"]) == 1
    parts = [{"part_kind": k, "content": k, "tool_name": n, "tool_call_id": 1, "args": '{"a": 1}'} for k, n in (("system-prompt", None), ("user-prompt", None), ("text", None), ("tool-call", "f"), ("tool-return", "f"), ("retry-prompt", "f"), ("retry-prompt", None), ("thinking", None))]
    (m,) = made([{"parts": parts, "model_name": "m1"}, {"parts": [], "model_name": None}], "pydantic_ai")
    assert roles_of(m) == ["system", "user", "assistant", "tool_call", "tool_response", "tool_response", "user"] and m.views["model"] == "m1"


def test_spans():
    a = {f"llm.{d}_messages.{i}.message.{f}": v for d, i, f, v in (("output", 0, "content", "A"), ("output", 0, "role", "ai"), ("input", 10, "content", "Q10"), ("input", 10, "role", "user"), ("input", 2, "content", "Q2"), ("input", 2, "role", "user"))}
    (m,) = made({"spans": [{"attributes": a | {"gen_ai.request.model": "m", "gen_ai.usage.input_tokens": 1}}, {"attributes": {"gen_ai.usage.input_tokens": 5, "model": "n"}}], "trace_id": 9}, "opentelemetry")
    assert [c for _, c in turns(m)] == ["Q2", "Q10", "A"] and m.views["model"] == "m" and m.views["token_usage"] == {"prompt_tokens": 5} and m.views["trace_id"] == "9"
    (m,) = made({"attributes": {"openinference.span.kind": "TOOL", "tool.name": "f", "input.value": '{"a": 1}', "output.value": "r"}}, "openinference")
    assert roles_of(m) == ["user", "assistant", "tool_call", "tool_response"]
    (m,) = made({"info": {"trace_id": "t", "request_metadata": {"k": 1}}, "data": {"spans": [{"attributes": {"input.value": '{"messages": [{"role": "system", "content": "rules"}]}'}}]}}, "mlflow")
    assert turns(m) == [("system", "rules")] and m.views["trace_id"] == "t" and m.metadata["k"] == 1
    assert made({"id": 3, "events": [{"input": "q"}]}, "agentops")[0].views["trace_id"] == "3"
    assert len(made({"events": [{"input": "q"}, {"input": "q"}]}, "agentops_events")[0].spans) == 3


def test_agentops_events_distinct():
    nan = json.loads('[{"a": NaN}, {"a": NaN}]')
    events = [{"a": 1, "b": [1, {"c": None}]}, {"b": [True, {"c": None}], "a": 1.0}, {"a": 1, "b": [{"c": None}, 1]}, {"a": "1"}, {}, {"a": []}, {"a": {}}, {"a": [[], 0]}, {"a": [0, []]}, *nan]
    (m,) = made({"events": events}, "agentops_events")
    distinct = []
    for e in events:
        if e and e not in distinct:
            distinct.append(e)
    assert [p["event"] for k, p in m.spans if k == "agentops.event"] == distinct and len(distinct) == 8
    deep = json.loads('{"a":' * 800 + "1" + "}" * 800)
    assert len(made({"events": [deep, deep]}, "agentops_events")[0].spans) == 3


def test_long_conversation_takes_linear_steps(monkeypatch):
    """Every message is signed a few times, and an event compared with few others, however many there are."""
    steps = {"signs": 0, "compared": 0}
    sign = adapters.Made.sign

    def counted(self, m):
        steps["signs"] += 1
        return sign(self, m)

    class Event(dict):
        __hash__ = None

        def __eq__(self, other):
            steps["compared"] += 1
            return dict.__eq__(self, other)

    monkeypatch.setattr(adapters.Made, "sign", counted)
    n = 300
    events = [Event(input=f"q{i // 2}", output=f"a{i // 2}") for i in range(n)]
    (m,) = made({"events": events}, "agentops_events")
    assert turns(m) == [t for i in range(n // 2) for t in (("user", f"q{i}"), ("assistant", f"a{i}"))] and len(m.spans) == n + n // 2
    assert steps["signs"] <= 4 * n and steps["compared"] <= 2 * n
    mixed = adapters.Made("x").add(adapters.said("user", "a")).add_new(adapters.said("user", "a"), adapters.said("user", "b"))
    mixed.add(adapters.said("user", "b"), adapters.said("user", "c")).add_new(adapters.said("user", "c"), adapters.said("user", "d"))
    assert [c for _, c in turns(mixed)] == ["a", "b", "b", "c", "d"]


def test_converter_memory_is_that_of_a_slice(spark):
    """Python holds the values of a slice of an Arrow batch, not of all its records."""

    class Plan:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    run = adapters.normalized(Plan(), "agentops_events")

    def batch(n):
        raw = [json.dumps({"events": [{"input": f"{i}:{k}" + "x" * 900, "output": "y"} for k in range(2)]}) for i in range(n)]
        raw[1::97] = [None] * len(raw[1::97])
        return pa.RecordBatch.from_pydict({"file": pa.array(["f"] * n), "pos": pa.array(range(n), pa.int64()), "raw": pa.array(raw, pa.string())})

    def peak(given):
        tracemalloc.start()
        try:
            keys = [k for b in run([given]) for k in b.column("rec_key").to_pylist()]
            return keys, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (few, low), (many, high) = peak(batch(1000)), peak(batch(4000))
    assert few == [f"f:{i}" for i in range(1000)] and many == [f"f:{i}" for i in range(4000)]
    assert high < 1.5 * low
    small = pa.RecordBatch.from_pydict({"file": pa.array(["f"] * 2500), "pos": pa.array(range(2500), pa.int64()), "raw": pa.array(['{"events":[]}'] * 2500)})
    assert [b.num_rows for b in run([small])] == [1000, 1000, 500]
    given = batch(1200)
    whole = [r for b in run([given]) for r in b.to_pylist()]
    assert whole == [r for i in range(0, 1200, 7) for b in run([given.slice(i, 7)]) for r in b.to_pylist()]
    assert sum(r["error"] is not None for r in whole) == 13


def test_mcp():
    log = [{"id": 1, "result": {"content": [{"text": "early"}]}}, {"id": "1", "method": "tools/call", "params": {"name": "t", "arguments": {"a": 1}, "_meta": {"mcp.session.id": "s"}}}, {"method": "notifications/progress"}, {"id": 1, "result": {"content": [{"text": "ok"}]}}, {"id": 8, "result": {}}]
    first, note = made({"messages": log}, "mcp")
    assert turns(first)[1] == ("tool_response", "ok") and first.session == "s" and note.metadata["method"] == "notifications/progress"
    (m,) = made({"request": {"id": 1, "method": "tools/list"}, "response": {"result": {"tools": [{"name": "x"}, "y"]}}}, "mcp")
    assert m.views["tools"] == [{"name": "x"}, {"name": "y"}]
    with pytest.raises(adapters.BadRecord):
        made({}, "mcp")


def test_local_shapes_and_rejects(spark):
    assert turns(made({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": {"a": 1}}]}, "auto")[0]) == [("user", "q"), ("assistant", '{"a": 1}')]
    assert turns(made({"instruction": "i", "input": "x", "output": "o", "history": [["a", "b"]]}, "auto")[0]) == [("user", "a"), ("assistant", "b"), ("user", "i\n\nx"), ("assistant", "o")]
    assert turns(made({"prompt": [{"role": "user", "content": "q"}], "chosen": "c"}, "preference")[0]) == [("user", "q"), ("assistant", "c")]
    raws = ['{"messages": [{"role": "user", "content": "q"}]}', '{"messages": ["invalid"]}', '{"prompt": "p", "completion": "c"}', "nonsense", "[1]"]
    df = spark.createDataFrame([("auto", "f", k, r) for k, r in enumerate(raws)], scans.RAW)
    out = adapters.normalized(df, "auto")
    assert [r["error"] is None for r in out.orderBy("rec_key").collect()] == [True, False, True, False, False]
    assert engine.accepted(out, skip_invalid=True).count() == 2 and engine.rejected(out).count() == 3
    with pytest.raises(Exception, match="record f:[134]"):
        engine.accepted(out).select("rec_key", "error").collect()
    with pytest.raises(adapters.UnknownSource):
        adapters.source_name("agno-mlflow")
    assert adapters.source_name("Atomic-Agents") == "atomic_agents" and set(adapters.sources()) >= {"pydantic_ai", "ag2"}
    again = adapters.normalized(df, "auto").select("id").collect()
    assert again == out.select("id").collect()


def test_canonical_passes_through(spark):
    record = {"id": "i", "messages": [{"role": "user", "content": "q", "tool_args": {"b": 1.50, "a": None}}], "source_framework": "x", "metadata": {"tool_schemas": [{"type": "function", "function": {"name": "f"}}]}}
    df = adapters.normalized(spark.createDataFrame([("agno", "f", 0, json.dumps(record))], scans.RAW), "agno")
    row = df.first()
    assert (row["id"], row["timestamp"], row["source_framework"]) == ("i", "", "x") and row["messages"][0]["tool_args"] == '{"b": 1.5, "a": null}'
    assert json.loads(formats.formatted(df, "openai_chat").first()["value"])["tools"] == record["metadata"]["tool_schemas"]
    assert json.loads(json.loads(formats.formatted(df, "sharegpt").first()["value"])["tools"]) == [{"name": "f"}]
    assert json.loads(formats.formatted(df, "canonical").first()["value"])["id"] == "i"


# formatters against a plain version


def plain_chat(messages):
    out, open_ = [], []
    for k, m in enumerate(messages):
        role, text = m["role"], m.get("content") or ""
        before = messages[k - 1]["role"] if k else None
        if role in ("system", "user"):
            out.append({"role": role, "content": text})
        elif role == "assistant" and (text.strip() or (k + 1 < len(messages) and messages[k + 1]["role"] == "tool_call")):
            out.append({"role": role, "content": text if text.strip() else ""})
        elif role == "tool_call":
            if before not in ("tool_call", "assistant"):
                out.append({"role": "assistant", "content": ""})
            id_ = m.get("tool_call_id") or "made"
            out[-1].setdefault("tool_calls", []).append({"id": id_, "type": "function", "function": {"name": m.get("tool_name") or "unknown_tool", "arguments": m.get("tool_args") or "{}"}})
            open_.append((id_, m.get("tool_name")))
        elif role == "tool_response":
            id_, hit = m.get("tool_call_id"), None
            if id_:
                hit = next((c for c in open_ if c[0] == id_), None)
            else:
                hit = next((c for c in open_ if m.get("tool_name") and c[1] == m["tool_name"]), open_[0] if open_ else None)
                id_ = hit[0] if hit else "call_unknown"
            if hit:
                open_.remove(hit)
            out.append({"role": "tool", "tool_call_id": id_, "content": m["tool_result"] if m.get("tool_result") is not None else text})
    return out


def random_chat(rng):
    out = []
    for k in range(rng.randrange(0, 14)):
        role = rng.choice(["system", "user", "assistant", "tool_call", "tool_call", "tool_response", "tool_response", "odd"])
        m = dict.fromkeys(FIELDS) | {"role": role, "content": rng.choice(["", " \t", "\u00a0", "text", 'q"uo\\te', "ü\n"])}
        if role.startswith("tool"):
            m["tool_name"] = rng.choice(["f", "g"])
        if role == "tool_call":
            m |= {"tool_call_id": f"c{k}", "tool_args": '{"n": 1}', "content": ""}
        if role == "tool_response":
            m |= {"tool_call_id": rng.choice([None, None, f"c{rng.randrange(14)}"]), "tool_result": rng.choice([None, "r"])}
        out.append(m)
    return out


def test_formatters_on_random_transcripts(spark):
    rng = random.Random(5)
    chats = [(k, random_chat(rng)) for k in range(300)]
    df = spark.createDataFrame(chats, f"k long, messages {MESSAGES}")
    got = {r["k"]: json.loads(r["value"])["messages"] for r in formats.formatted(df, "openai_chat").collect()}
    assert got == {k: plain_chat(m) for k, m in chats}
    strict = {r["k"]: json.loads(r["value"])["messages"] for r in formats.formatted(df, "openai_chat", strict=True).collect()}
    assert strict == {k: [t for t in plain_chat(m) if t.get("tool_call_id") != "call_unknown"] for k, m in chats}
    alpaca = {r["k"]: json.loads(r["value"]) for r in formats.formatted(df, "alpaca").collect()}
    pref = {r["k"]: json.loads(r["value"]) for r in formats.formatted(df, "preference").collect()}
    share = {r["k"]: json.loads(r["value"]) for r in formats.formatted(df, "sharegpt").collect()}
    pc = {r["k"]: json.loads(r["value"]) for r in formats.formatted(df, "prompt_completion").collect()}
    for k, m in chats:
        users, told = [x["content"] for x in m if x["role"] == "user"], [x["content"] for x in m if x["role"] == "assistant" and x["content"].strip()]
        assert (alpaca[k]["instruction"], alpaca[k]["output"]) == ((users or [""])[-1], (told or [""])[-1])
        pairs = [list(p) for p in zip(users, told)]
        assert alpaca[k].get("history") == (pairs[:-1] if len(pairs) > 1 else None)
        assert pc[k] == {"prompt": (users or [""])[0], "completion": (told or [""])[-1]}
        chat = plain_chat(m)
        at = max((i for i, t in enumerate(chat) if t["role"] == "assistant" and t["content"]), default=None)
        assert (pref[k]["prompt"], pref[k]["chosen"]) == ((chat, []) if at is None else (chat[:at], [chat[at]]))
        want = [("human" if x["role"] == "user" else "gpt" if x["role"] == "assistant" else x["role"], x["content"]) for x in m if x["role"] in ("user", "odd") or (x["role"] == "assistant" and x["content"].strip())]
        assert [(t["from"], t["value"]) for t in share[k]["conversations"] if t["from"] in ("human", "gpt", "odd")] == want
        assert all(json.loads(t["value"]) == {"name": json.loads(t["value"])["name"], "arguments": {"n": 1}} for t in share[k]["conversations"] if t["from"] == "function_call")


def test_call_fields_from_content_and_made_ids(spark):
    m = dict.fromkeys(FIELDS)
    chat = [m | {"role": "tool_call", "content": '{"tool_name": "f", "tool_args": {"a": 1}}'}, m | {"role": "tool_call", "content": "not json"}, m | {"role": "tool_response", "content": "r", "tool_name": "f"}]
    df = spark.createDataFrame([(1, chat)], f"k long, messages {MESSAGES}")
    (turn, result) = json.loads(formats.formatted(df, "openai_chat", key=F.col("k")).first()["value"])["messages"]
    assert [c["function"]["name"] for c in turn["tool_calls"]] == ["f", "unknown_tool"] and turn["tool_calls"][0]["function"]["arguments"] == '{"a":1}'
    ids = [c["id"] for c in turn["tool_calls"]]
    assert len({*ids}) == 2 and all(i.startswith("call_") and len(i) == 13 for i in ids) and result["tool_call_id"] == ids[0]
    assert formats.formatted(df, "preference", require_rejected=True).count() == 0
    assert json.loads(formats.formatted(df, "preference", rejected="no").first()["value"])["rejected"][0]["content"] == "no"
    with pytest.raises(formats.UnknownFormat):
        formats.formatted(df, "chatml")
    assert formats.available_formats() == ["openai_chat", "sharegpt", "alpaca", "prompt_completion", "preference"]


def test_format_messages(spark):
    assert engine.format_messages(spark, [{"role": "user", "content": "p"}, {"role": "assistant", "content": "c"}], "prompt_completion") == {"prompt": "p", "completion": "c"}
    with pytest.raises(engine.FormatValidationError):
        engine.format_messages(spark, [], "none")


# JSON and roles


def test_json_columns(spark):
    rows = [('{"primary": null, "secondary": 2}',), ('{"secondary": "s", "a.b": {"c": 1.50}}',), ("[1, {}]",), (None,), ("{bad",), ('"text"',), ("\u00a0\u2003 ",)]
    df = spark.createDataFrame(rows, "j string")
    got = df.select(
        jsonx.first_present(F.col("j"), "primary", "secondary").alias("p"), jsonx.first_truthy(F.col("j"), "primary", "secondary").alias("t"), jsonx.kind(F.col("j")).alias("k"),
        F.size(jsonx.as_list(F.col("j"))).alias("n"), jsonx.get(F.col("j"), "a.b", "c").alias("d"), jsonx.not_blank(F.col("j")).alias("b"), jsonx.stripped(F.col("j")).alias("s"),
    ).collect()
    assert [r["p"] for r in got] == [None, "s", None, None, None, None, None] and [r["t"] for r in got][:2] == ["2", "s"]
    assert [r["k"] for r in got] == ["object", "object", "array", None, None, "string", None] and [r["n"] for r in got] == [1, 1, 2, 0, 1, 1, 1]
    assert got[1]["d"] in ("1.50", "1.5") and [r["b"] for r in got] == [True] * 3 + [False, True, True, False] and got[6]["s"] == ""


def test_roles(spark):
    df = spark.createDataFrame([(" Human\u00a0",), ("GPT",), ("tool",), (None,), ("zzz",)], "r string")
    assert [r[0] for r in df.select(roles.normalized(F.col("r"))).collect()] == ["user", "assistant", "tool_response", "assistant", "assistant"]
    assert [r[0] for r in df.select(roles.of_sender(F.col("r"))).collect()] == [" Human\u00a0", "GPT", "tool", None, "zzz"]


def test_dedup_compares_arguments_as_json(spark):
    m = dict.fromkeys(FIELDS) | {"role": "tool_call", "content": "c"}
    chat = [m | {"tool_args": '{"a": 1, "b": 2}'}, m | {"tool_args": '{"b":2,"a":1}'}, m | {"tool_args": None}, m | {"tool_args": None, "tool_result": "x"}]
    df = spark.createDataFrame([(1, chat), (2, []), (3, None)], f"k long, messages {MESSAGES}")
    assert {r["k"]: r["n"] for r in conversation.deduplicated(df).select("k", F.size("messages").alias("n")).collect() if r["k"] < 3} == {1: 2, 2: 0}


# validators


def test_validators(spark):
    check = validate.validate_record
    call = {"id": "1", "type": "function", "function": {"name": "f", "arguments": "{}"}}
    assert check({"messages": [{"role": "assistant", "content": "", "tool_calls": [call]}, {"role": "tool", "tool_call_id": "1", "content": "x"}]}, "openai_chat") == []
    bad = check({"messages": ["x", {"role": 3}, {"role": "assistant", "tool_calls": [1, {}, call | {"function": {"name": "f", "arguments": {}}}]}, {"role": "tool", "content": 3}, {"role": "tool", "tool_call_id": "9", "content": "c"}]}, "openai_chat")
    assert len(bad) == 10 and all(i.startswith("openai_chat: message[") for i in bad)
    assert len(check({"conversations": [{"from": "system", "value": "s"}, {"from": "function_call", "value": "{}"}, {"from": "x", "value": 3}, 4], "system": 1}, "sharegpt")) == 6
    assert len(check({"instruction": 3, "input": "", "history": [["a"], ["a", "b"]], "system": 3}, "alpaca")) == 4
    assert check({"prompt": None}, "prompt_completion") == ["prompt_completion: 'prompt' must be a string", "prompt_completion: missing required key 'completion'"]
    assert len(check({"prompt": [], "chosen": [{"role": "a"}]}, "preference")) == 2 and check([], "alpaca") == ["alpaca: record must be an object"]
    with pytest.raises(validate.InvalidRecord):
        validate.assert_valid({}, "alpaca")
    df = spark.createDataFrame([(1, '{"prompt": "a", "completion": "b"}'), (2, "{"), (3, None)], "k long, value string")
    good, wrong = validate.split(df, "prompt_completion")
    assert [r["k"] for r in good.collect()] == [1] and [r["k"] for r in wrong.orderBy("k").collect()] == [2, 3]
    with pytest.raises(Exception, match="not JSON"):
        validate.asserted(df, "prompt_completion").collect()


# scans and sinks


def test_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1.50}, {"b": [1, 2]} ,"x"]')
    (tmp_path / "one.json").write_text('{"a": 1}')
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write('{"a": 3}\n')
    raw = lambda p, s="auto": [r["raw"] for r in scans.read(spark, str(tmp_path / p), s).orderBy("pos").collect()]
    assert raw("a.json") == ['{"a": 1.50}', '{"b": [1, 2]}', '"x"'] and raw("one.json") == ['{"a": 1}']
    assert raw("l.jsonl") == ['{"a": 1}', '{"a": 2}'] and raw("z.jsonl.gz", "agno") == ['{"a": 3}']
    assert [r["pos"] for r in scans.numbered_jsonl(spark, str(tmp_path / "l.jsonl")).collect()] == [0, 1]
    assert scans.is_lines("x.NDJSON.gz") and not scans.is_lines("x.json") and scans.is_lines("x.json", "jsonl")
    assert scans.given(spark, "").count() == 0 and scans.given(spark, '{"a": 1}\n{"b": 2}').count() == 2 and scans.given(spark, "[1, 2]").count() == 2
    with pytest.raises(scans.BadInput, match="line 2"):
        scans.given(spark, '{"a": 1}\nnope')
    good, bad = scans.split(scans.read(spark, str(tmp_path / "a.json")))
    assert good.count() == 2 and [r["error"] for r in bad.collect()] == ["not a JSON object"]


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("name", ["o.jsonl", "o.jsonl.gz"])
def test_sinks(spark, tmp_path, single, name):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":"ü"}',)], "value string")
    path = str(tmp_path / name)
    r = storage.write_jsonl(df, path, single=single)
    assert (r.records_written, r.bytes_written, r.backend) == (2, len('{"a":1}\n{"a":"ü"}\n'.encode()), "local")
    storage.write_jsonl(df.limit(1), path, "a", single=single)
    b, a = '{"a":1}', '{"a":"ü"}'
    assert sorted(x["value"] for x in storage.read_jsonl(spark, path).collect()) in ([a, a, b], [a, b, b])
    storage.write_jsonl(df.limit(0), path, single=single)
    assert storage.read_jsonl(spark, path).count() == 0
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception, match="not JSON"):
        storage.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


@pytest.mark.parametrize("single", [True, False])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, single):
    path, ok = str(tmp_path / "o.jsonl"), spark.createDataFrame([(f'{{"a":{k}}}',) for k in range(9)], "value string").repartition(4)
    storage.write_jsonl(ok, path, single=single)
    bad = ok.select(F.when(F.col("value") == '{"a":8}', F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("value")).alias("value"))
    for mode in "wa":
        if single or mode == "w":
            with pytest.raises(Exception, match="stop"):
                storage.write_jsonl(bad, path, mode, single=single)
    assert sorted(r["value"] for r in storage.read_jsonl(spark, path).collect()) == sorted(r["value"] for r in ok.collect())
    storage.write_jsonl(ok.limit(2), path, single=single)
    assert storage.read_jsonl(spark, path).count() == 2
    assert [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["o.jsonl"]


def test_one_file_keeps_the_order_of_rows(spark, tmp_path):
    df = spark.range(1000, numPartitions=7).selectExpr("concat('{\"a\":', id, '}') as value")
    storage.write_jsonl(df, str(tmp_path / "o.jsonl.gz"), single=True)
    with gzip.open(tmp_path / "o.jsonl.gz", "rt") as f:
        assert [json.loads(x)["a"] for x in f] == list(range(1000))


def test_places(spark, tmp_path):
    p = storage.Place.parse("postgresql://me:secret@host:5432/db?schema=s&table=t&sslmode=require")
    o = storage.jdbc_plan(p)
    assert o["dbtable"] == '"s"."t"' and o["user"] == "me" and o["password"] == "secret" and "stringtype=unspecified" in o["url"] and "secret" not in p.shown + o["url"]
    assert "payload jsonb" in storage.jdbc_ddl(o)
    with pytest.raises(storage.StorageError):
        storage.jdbc_plan(storage.Place.parse("postgresql://h/db?table=a;b"))
    with pytest.raises(storage.StorageError):
        storage.spark_path(spark, "postgresql://h/db")
    assert storage.spark_path(spark, "s3://b/k") == "s3a://b/k" and storage.spark_path(spark, "gcs://b/k") == "gs://b/k" and storage.Place.parse("c://x").scheme == "file"
    assert storage.spark_path(spark, "r2://b/k?endpoint_url=http://e") == "s3a://b/k"
    with pytest.raises(storage.StorageError):
        storage.backend_of("ftp://x")
    storage.register_backend("mine", "mine", lambda _, p: str(tmp_path / p.path))
    storage.write_jsonl(spark.createDataFrame([("{}",)], "value string"), "mine://x/out", single=True)
    assert storage.check(spark, "mine://x/out")["exists"] is True and storage.check(spark, str(tmp_path / "none"))["exists"] is False
    storage.register_backend("table", "table", lambda _, p: str(tmp_path / p.path), lambda df, p, mode: df.write.mode("append" if mode == "a" else "overwrite").parquet(str(tmp_path / p.path)))
    for mode, n in (("w", 1), ("a", 2), ("w", 1)):
        assert storage.write_jsonl(spark.createDataFrame([("{}",)], "value string"), "table://x/own", mode).records_written == 1
        assert spark.read.parquet(str(tmp_path / "own")).count() == n
    storage.write_json(spark, {"ü": 1}, str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{"ü":1}\n'
    assert storage.key_values(["a=b=c"]) == {"a": "b=c"} and list(storage.batched([1, 2, 3], 2)) == [[1, 2], [3]]
    for wrong in ("=x", "x"):
        with pytest.raises(ValueError):
            storage.key_values([wrong])


def test_cli(spark, tmp_path, capfd):
    (tmp_path / "in.jsonl").write_text('{"messages": [{"role": "user", "content": "q"}]}\n{"messages": ["invalid"]}\n{"prompt": "p", "completion": "c"}\n')
    run = lambda *a: cli.main([*a], spark)
    assert run("convert", "auto", str(tmp_path / "in.jsonl"), "-f", "sharegpt") == 1
    assert run("convert", "auto", str(tmp_path / "in.jsonl"), "-f", "prompt_completion", "--skip-invalid", "-o", str(tmp_path / "o.jsonl.gz")) == 0
    assert run("convert", "auto", str(tmp_path / "in.jsonl"), "-f", "prompt_completion", "--skip-invalid", "--append", "-o", str(tmp_path / "o.jsonl.gz")) == 0
    with gzip.open(tmp_path / "o.jsonl.gz", "rt") as f:
        assert [json.loads(x) for x in f] == [{"prompt": "q", "completion": ""}, {"prompt": "p", "completion": "c"}] * 2
    assert run("info") == 0 and run("storage", "check", str(tmp_path)) == 0 and run("convert", "nope", "x") == 1
    assert "agno" in capfd.readouterr().out


# streams


def fragments(spark):
    m = lambda role, text: dict.fromkeys(FIELDS) | {"role": role, "content": text}
    rows = [("a", 1, [m("user", "q")], 1, 5), ("b", 1, [m("user", "x")], 1, 5), ("a", 2, [m("user", "q"), m("assistant", "Final Answer: 1")], 2, 5), ("b", 2, [m("assistant", "y")], 5, 5), ("a", 3, [m("user", "again")], 1, 5), ("b", 3, [m("user", "z")], 9, 5)]
    return spark.createDataFrame(rows, sessions.EVENT)


def test_stream_equals_batch(spark, tmp_path):
    df = fragments(spark)
    for k in range(3):  # one file a micro-batch
        df.where(F.col("seq") == k + 1).coalesce(1).write.parquet(str(tmp_path / f"s{k}"))
        df.where(F.col("seq") == k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.STORE)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    sessions.start(sessions.merge_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"), sink=lambda b, n: seen.extend(b.collect())).awaitTermination()
    want = sorted((r["session"], r["segment"], r["messages"]) for r in sessions.merge_batch(df).where("complete").collect())
    assert sorted((r["session"], r["segment"], r["messages"]) for r in seen) == want and len(want) == 3
    held = sessions.pending(spark, str(tmp_path / "cp")).collect()  # what the stopped query still has
    left = sessions.merge_batch(df).where("not complete").collect()
    assert [(r["session"], r["messages"], r["complete"]) for r in held] == [(r["session"], r["messages"], False) for r in left] and len(left) == 1
    sessions.start(sessions.merge_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp2"), "prompt_completion").awaitTermination()
    stored = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {"prompt": "q", "completion": "Final Answer: 1"} in stored and len(stored) == 3


def test_stream_helpers(spark):
    key = spark.createDataFrame([("c", "a", None), (None, "", "t")], "c string, a string, t string").select(sessions.session_key(F.col("c"), F.col("a"), F.col("t")))
    assert [r[0] for r in key.collect()] == ["c:a:unknown", "unknown:t"]
    df = spark.createDataFrame([("k", 1, "old", "MessageChunk"), ("k", 2, "new", "Done")], "key string, at long, v string, event_type string")
    assert sessions.latest(df, "key", "at").first()["v"] == "new" and sessions.without_chunks(df).count() == 1 and sessions.without_chunks(df, include=True).count() == 2


# the catalogue


def test_every_query_has_sql_with_its_columns():
    duckdb = pytest.importorskip("duckdb")
    assert set(catalog.oracle_sql()) == set(catalog.queries())
    assert duckdb is not None


def test_schema_is_parsed(spark):
    assert spark.createDataFrame([], INTERACTION).columns[:3] == ["rec_key", "sub_pos", "id"]
