"""All queries over the reference's own operators, and SQL with the same result for each.

They run on whole tables. Where the tables have no such records (tool calls, spans, JSON-RPC, framework
exports), records are made from all rows of a table first.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, roles
from ..operators import conversation as conv
from ..operators import formats, validate
from ..sources import scans, storage
from ..streaming import sessions
from . import adapters, engine

Query = Callable[[SparkSession, str], DataFrame]
_made: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _made[name or f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _made.items() if sql}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.collected(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


# formats

_BLANK = r"regexp_matches(text, '\S')"
_OBJ = "json_object('role', role, 'content', text)"


def _format(name: str, **options) -> Query:
    return lambda spark, sf_dir: formats.formatted(_chats(spark, sf_dir), name, **options).select("conv_id", "value")


_query(f"""
SELECT conv_id, CAST(json_object('messages', list({_OBJ} ORDER BY turn)) AS VARCHAR) AS value
FROM conversations WHERE role <> 'assistant' OR {_BLANK} GROUP BY conv_id""", "fmt_openai_chat")(_format("openai_chat"))

_query(f"""
WITH t AS (
  SELECT conv_id, list(json_object('from', CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END, 'value', text) ORDER BY turn)
      FILTER (role = 'user' OR (role = 'assistant' AND {_BLANK})) AS c,
    arg_min(text, turn) FILTER (role = 'system' AND text <> '') AS s FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN s IS NULL THEN json_object('conversations', coalesce(c, [])) ELSE json_object('conversations', coalesce(c, []), 'system', s) END AS VARCHAR) AS value
FROM t""", "fmt_sharegpt")(_format("sharegpt"))

_TURNS = f"""
SELECT conv_id, coalesce(list(text ORDER BY turn) FILTER (role = 'user'), []) AS u,
  coalesce(list(text ORDER BY turn) FILTER (role = 'assistant' AND {_BLANK}), []) AS a,
  arg_min(text, turn) FILTER (role = 'system') AS s FROM conversations GROUP BY conv_id"""


def _alpaca_sql(first: str) -> str:
    return f"""
WITH t AS ({_TURNS}),
h AS (SELECT *, coalesce(u[-1], '') AS ask, coalesce(a[-1], '') AS told, least(len(u), len(a)) AS n FROM t),
p AS (SELECT *, CASE WHEN n > 1 THEN list_transform(range(1, n), lambda k: [u[k], a[k]]) END AS history FROM h)
SELECT conv_id, CAST(CASE
  WHEN {first} THEN CASE WHEN history IS NULL THEN json_object('instruction', s, 'input', ask, 'output', told)
    ELSE json_object('instruction', s, 'input', ask, 'output', told, 'history', history) END
  WHEN s IS NULL AND history IS NULL THEN json_object('instruction', ask, 'input', '', 'output', told)
  WHEN s IS NULL THEN json_object('instruction', ask, 'input', '', 'output', told, 'history', history)
  WHEN history IS NULL THEN json_object('instruction', ask, 'input', '', 'output', told, 'system', s)
  ELSE json_object('instruction', ask, 'input', '', 'output', told, 'system', s, 'history', history) END AS VARCHAR) AS value FROM p"""


_query(_alpaca_sql("false"), "fmt_alpaca")(_format("alpaca"))
_query(_alpaca_sql("s IS NOT NULL"), "fmt_alpaca_system_as_instruction")(_format("alpaca", system_as_instruction=True))
_query(f"WITH t AS ({_TURNS}) SELECT conv_id, CAST(json_object('prompt', coalesce(u[1], ''), 'completion', coalesce(a[-1], '')) AS VARCHAR) AS value FROM t", "fmt_prompt_completion")(_format("prompt_completion"))
_query(f"""
WITH t AS (
  SELECT conv_id, list({_OBJ} ORDER BY turn) AS m, list(role ORDER BY turn) AS r FROM conversations WHERE role <> 'assistant' OR {_BLANK} GROUP BY conv_id),
k AS (SELECT *, len(r) - list_position(list_reverse(r), 'assistant') + 1 AS pos FROM t),
j AS (SELECT conv_id, [json_object('role', 'assistant', 'content', '')] AS no,
  CASE WHEN pos IS NULL THEN m ELSE m[1:pos - 1] END AS p, CASE WHEN pos IS NULL THEN m[1:0] ELSE m[pos:pos] END AS c FROM k)
SELECT conv_id, CAST(json_object('prompt', p, 'chosen', c, 'rejected', no) AS VARCHAR) AS value FROM j""", "fmt_preference")(_format("preference"))


@_query(f"""
WITH t AS ({_TURNS}), p AS (SELECT conv_id, unnest(range(1, least(len(u), len(a)))) AS k, u, a FROM t)
SELECT conv_id, k AS pair, u[k] AS asked, a[k] AS told FROM p""")
def alpaca_history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.from_json("value", "history array<array<string>>")
    made = formats.formatted(_chats(spark, sf_dir), "alpaca").select("conv_id", F.posexplode(value["history"]).alias("k", "h"))
    return made.select("conv_id", (F.col("k") + 1).cast("bigint").alias("pair"), F.get("h", F.lit(0)).alias("asked"), F.get("h", F.lit(1)).alias("told"))


# readers and converters


def _converted(df: DataFrame, source: str, **options) -> DataFrame:
    """Messages of (conv_id, raw) after a converter, as rows."""
    raw = df.select(F.lit(source).alias("source"), F.lit("t").alias("file"), F.col("conv_id").alias("pos"), "raw")
    made = adapters.normalized(raw, source, **options).where("error is null")
    key = F.split_part("rec_key", F.lit(":"), F.lit(2)).cast("bigint").alias("conv_id")
    return made.select(key, F.posexplode("messages").alias("seq", "m")).select("conv_id", F.col("seq").cast("bigint").alias("seq"), "m.role", "m.content")


def _rows_sql(where: str = "true", unique: bool = False, role: str = "role") -> str:
    keep = "QUALIFY row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) = 1" if unique else ""
    return f"""
WITH t AS (SELECT conv_id, turn, {role} AS role, text FROM conversations WHERE {where}),
d AS (SELECT * FROM t {keep})
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role, text AS content FROM d"""


@_query(_rows_sql(f"role = 'user' OR (role = 'assistant' AND {_BLANK})"))
def read_sharegpt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(formats.formatted(_chats(spark, sf_dir), "sharegpt", out="raw"), "sharegpt")


@_query(f"""
WITH t AS ({_TURNS}), h AS (SELECT conv_id, u, a, least(len(u), len(a)) AS n FROM t),
l AS (SELECT conv_id, flatten(list_transform(range(1, greatest(n, 1)), lambda k: [{{'role': 'user', 'content': u[k]}}, {{'role': 'assistant', 'content': a[k]}}]))
  || CASE WHEN coalesce(u[-1], '') = '' THEN [] ELSE [{{'role': 'user', 'content': u[-1]}}] END
  || CASE WHEN coalesce(a[-1], '') = '' THEN [] ELSE [{{'role': 'assistant', 'content': a[-1]}}] END AS m FROM h),
x AS (SELECT conv_id, m, unnest(range(1, len(m) + 1)) AS k FROM l)
SELECT conv_id, k - 1 AS seq, m[k].role AS role, m[k].content AS content FROM x""")
def read_alpaca_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(formats.formatted(_chats(spark, sf_dir), "alpaca", out="raw"), "alpaca")


@_query(f"""
WITH t AS ({_TURNS})
SELECT conv_id, CAST(0 AS BIGINT) AS seq, 'user' AS role, coalesce(u[1], '') AS content FROM t
UNION ALL SELECT conv_id, 1, 'assistant', coalesce(a[-1], '') FROM t""")
def read_prompt_completion_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(formats.formatted(_chats(spark, sf_dir), "prompt_completion", out="raw"), "prompt_completion")


def _exported(spark: SparkSession, sf_dir: str, record: Callable[[Column], Column], role: str = "role", content: str = "content", **more: Callable[[Column], Column]) -> DataFrame:
    """(conv_id, raw): every conversation as a record of some framework. record: of the list of turns."""
    turn = lambda m: F.struct(m["role"].alias(role), m["content"].alias(content), *(f(m).alias(k) for k, f in more.items()))
    chats = _chats(spark, sf_dir).withColumn("t", F.transform("messages", turn))
    return chats.select("conv_id", F.to_json(record(F.col("t"))).alias("raw"))


def _adapter(query: str, source: str, record: Callable[[Column], Column], sql: str, /, **options) -> None:
    _query(sql, query)(lambda spark, sf_dir: _converted(_exported(spark, sf_dir, record, **options), source))


_adapter("adapt_langgraph_state", "langgraph", lambda t: F.struct(F.struct(t.alias("messages"), F.lit(1).alias("step")).alias("state")), _rows_sql())
_adapter("adapt_langgraph_stream", "langgraph", lambda t: F.struct(F.array(F.struct(F.lit("updates").alias("type"), F.struct(F.struct(t.alias("messages")).alias("node")).alias("data")), F.struct(F.lit("values").alias("type"), F.struct(F.struct(t.alias("messages")).alias("node")).alias("data"))).alias("events")), _rows_sql(unique=True))
_adapter("adapt_crewai", "crewai", lambda t: F.struct(t.alias("messages"), F.lit("m").alias("model")), _rows_sql())
_adapter("adapt_agno_run", "agno", lambda t: F.struct(F.lit("r1").alias("run_id"), t.alias("messages")), _rows_sql())
_adapter("adapt_agno_session", "agno", lambda t: F.struct(F.lit("s1").alias("session_id"), F.array(F.struct(t.alias("messages"))).alias("runs")), _rows_sql())
_adapter("adapt_autogen", "autogen", lambda t: F.struct(t.alias("messages"), F.lit("done").alias("stop_reason")), _rows_sql(unique=True), role="source")
_adapter("adapt_ag2_inverted", "ag2", lambda t: F.struct(t.alias("chat_history")), _rows_sql(unique=True, role="CASE WHEN role = 'system' THEN role WHEN role = (SELECT arg_min(c.role, c.turn) FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.role <> 'system') THEN 'user' ELSE 'assistant' END"), name=lambda m: F.when(m["role"] != "system", m["role"]))
_adapter("adapt_atomic_history", "atomic_agents", lambda t: F.struct(t.alias("history")), _rows_sql("text <> ''"))
_adapter("adapt_pydantic_ai", "pydantic_ai", lambda t: F.struct(F.array(F.struct(t.alias("parts"), F.lit("m").alias("model_name"))).alias("messages")), _rows_sql(), role="role_", part_kind=lambda m: F.when(m["role"] == "user", "user-prompt").when(m["role"] == "system", "system-prompt").otherwise("text"))
_adapter("adapt_openinference", "openinference", lambda t: F.struct(F.array(F.struct(F.lit("llm").alias("name"), F.create_map(F.lit("input.value"), F.to_json(F.struct(t.alias("messages")))).alias("attributes"))).alias("spans")), _rows_sql(unique=True))
_adapter("adapt_mlflow", "mlflow", lambda t: F.struct(F.struct(F.lit("tr").alias("trace_id")).alias("info"), F.struct(F.array(F.struct(F.create_map(F.lit("input.value"), F.to_json(t)).alias("attributes"))).alias("spans")).alias("data")), _rows_sql(unique=True))
_adapter("adapt_agentops", "agentops", lambda t: F.struct(F.lit("x").alias("id"), F.array(F.struct(F.create_map(F.lit("gen_ai.prompt"), F.to_json(t)).alias("attributes"))).alias("operations")), _rows_sql(unique=True))

_TOOL_SQL = """
SELECT conv_id, turn * 2 + k AS seq, CASE k WHEN 0 THEN 'tool_call' ELSE 'tool_response' END AS role,
  CASE k WHEN 0 THEN '{"tool_name": "say", "tool_args": {"turn": ' || turn || '}}' ELSE text END AS content
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text FROM conversations), (VALUES (0), (1)) AS v(k)"""


@_query(_TOOL_SQL)
def adapt_mcp_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a request and its response; all responses come before all requests."""
    chats = _chats(spark, sf_dir)
    ask = F.transform("messages", lambda m, i: F.to_json(F.struct(i.alias("id"), F.lit("tools/call").alias("method"), F.struct(F.lit("say").alias("name"), F.struct(i.alias("turn")).alias("arguments")).alias("params"))))
    tell = F.transform("messages", lambda m, i: F.to_json(F.struct(i.cast("string").alias("id"), F.struct(F.array(F.struct(m["content"].alias("text"))).alias("content")).alias("result"))))
    raw = F.concat(F.lit('{"messages":['), F.array_join(F.concat(tell, ask), ","), F.lit("]}"))
    rows = chats.select(F.lit("mcp").alias("source"), F.lit("t").alias("file"), F.col("conv_id").alias("pos"), raw.alias("raw"))
    made = adapters.normalized(rows, "mcp").select(F.split_part("rec_key", F.lit(":"), F.lit(2)).cast("bigint").alias("conv_id"), "sub_pos", F.posexplode("messages").alias("k", "m"))
    return made.select("conv_id", (F.col("sub_pos") * 2 + F.col("k")).cast("bigint").alias("seq"), "m.role", "m.content")


@_query("""
SELECT conv_id, CAST(0 AS BIGINT) AS seq, 'tool_call' AS role, '{"tool_name": "say", "tool_args": {"turn": ' || turn || '}}' AS content, turn FROM conversations
UNION ALL SELECT conv_id, 1, 'tool_response', text, turn FROM conversations""")
def adapt_crewai_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    raw = F.to_json(F.struct(F.lit("say").alias("tool_name"), F.struct("turn").alias("tool_input"), F.col("text").alias("tool_result")))
    df = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), raw.alias("raw"))
    out = _converted(df, "crewai")
    return out.select(F.expr("conv_id div 1000").cast("bigint").alias("conv_id"), "seq", "role", "content", (F.col("conv_id") % 1000).alias("turn"))


@_query("""
SELECT conv_id, turn, session, CASE WHEN text = '' THEN NULL ELSE 'tool' END AS kind FROM (
  SELECT conv_id, turn, 'c' || conv_id || ':' || role || ':unknown' AS session, text FROM conversations)""")
def crewai_session_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    key = sessions.session_key(F.concat(F.lit("c"), "conv_id"), F.col("role"), F.lit(None).cast("string"))
    return c.select("conv_id", "turn", key.alias("session"), F.when(F.col("text") != "", "tool").alias("kind"))


# tool turns


def _tool_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with calls put in: after a user turn two, whose results come the other way round and name
    no id, the second not even a tool; after an assistant turn one without an id."""
    of = lambda m, i: F.concat(F.lit('{"n":'), i.cast("string"), F.lit("}"))
    role = lambda r, content=F.lit(""), **more: conv.message(F.lit(r), content, **more)

    def turns(m: Column, i: Column) -> Column:
        find = role("tool_call", tool_call_id=F.concat(F.lit("a"), i.cast("string")), tool_name=F.lit("find"), tool_args=of(m, i))
        look = role("tool_call", tool_call_id=F.concat(F.lit("b"), i.cast("string")), tool_name=F.lit("look"), tool_args=of(m, i))
        asked = F.array(m, find, look, role("tool_response", F.lit("unused"), tool_name=F.lit("look"), tool_result=F.lit("seen")), role("tool_response", m["content"]))
        told = F.array(m, role("tool_call", tool_name=F.lit("say")), role("tool_response", F.lit("ok"), tool_name=F.lit("say")))
        return F.when(m["role"] == "user", asked).when(m["role"] == "assistant", told).otherwise(F.array(m))

    return _chats(spark, sf_dir).withColumn("messages", F.flatten(F.transform("messages", turns)))


def _tool_format(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keyed = {"key": F.col("conv_id")} if name != "sharegpt" else {}
        return formats.formatted(_tool_chats(spark, sf_dir), name, **keyed).select("conv_id", "value")

    return run


def _call_sql(id_: str, name: str, args: str) -> str:
    return f"json_object('id', {id_}, 'type', 'function', 'function', json_object('name', '{name}', 'arguments', {args}))"


_TOOL_CHAT_SQL = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE role WHEN 'user' THEN 5 WHEN 'assistant' THEN 3 ELSE 1 END AS wide FROM conversations),
g AS (SELECT *, '{{"n":' || i || '}}' AS args, 'call_' || substr(sha256(conv_id || ':' || (sum(wide) OVER (PARTITION BY conv_id ORDER BY turn) - wide + 1)), 1, 8) AS made FROM n),
t AS (SELECT conv_id, turn, CASE role
  WHEN 'user' THEN [json_object('role', role, 'content', text),
    json_object('role', 'assistant', 'content', '', 'tool_calls', [{_call_sql("'a' || i", 'find', 'args')}, {_call_sql("'b' || i", 'look', 'args')}]),
    json_object('role', 'tool', 'content', 'seen', 'tool_call_id', 'b' || i), json_object('role', 'tool', 'content', text, 'tool_call_id', 'a' || i)]
  WHEN 'assistant' THEN [json_object('role', role, 'content', CASE WHEN {_BLANK} THEN text ELSE '' END, 'tool_calls', [{_call_sql('made', 'say', "'{}'")}]),
    json_object('role', 'tool', 'content', 'ok', 'tool_call_id', made)]
  ELSE [json_object('role', role, 'content', text)] END AS m,
  CASE role WHEN 'user' THEN ['', '', '', ''] WHEN 'assistant' THEN [CASE WHEN {_BLANK} THEN 'told' ELSE '' END, ''] ELSE [''] END AS said FROM g),
chat AS (SELECT conv_id, flatten(list(m ORDER BY turn)) AS m, flatten(list(said ORDER BY turn)) AS said FROM t GROUP BY conv_id)"""
_query(_TOOL_CHAT_SQL + " SELECT conv_id, CAST(json_object('messages', m) AS VARCHAR) AS value FROM chat", "fmt_openai_chat_tools")(_tool_format("openai_chat"))
_query(
    _TOOL_CHAT_SQL
    + """, k AS (SELECT *, CASE WHEN list_contains(said, 'told') THEN len(said) - list_position(list_reverse(said), 'told') + 1 END AS pos FROM chat),
j AS (SELECT conv_id, [json_object('role', 'assistant', 'content', '')] AS no, CASE WHEN pos IS NULL THEN m ELSE m[1:pos - 1] END AS p, CASE WHEN pos IS NULL THEN m[1:0] ELSE m[pos:pos] END AS c FROM k)
SELECT conv_id, CAST(json_object('prompt', p, 'chosen', c, 'rejected', no) AS VARCHAR) AS value FROM j""",
    "fmt_preference_tools",
)(_tool_format("preference"))


def _shared_call_sql(name: str, args: str) -> str:
    return f"""json_object('from', 'function_call', 'value', '{{"name": "{name}", "arguments": ' || {args} || '}}')"""


_query(f"""
WITH n AS (SELECT *, '{{"n":' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '}}' AS args FROM conversations),
t AS (SELECT conv_id, turn, role, text, CASE role
  WHEN 'user' THEN [json_object('from', 'human', 'value', text), {_shared_call_sql('find', 'args')}, {_shared_call_sql('look', 'args')},
    json_object('from', 'observation', 'value', 'seen'), json_object('from', 'observation', 'value', text)]
  WHEN 'assistant' THEN CASE WHEN {_BLANK} THEN [json_object('from', 'gpt', 'value', text)] ELSE [] END
    || [{_shared_call_sql('say', "'{}'")}, json_object('from', 'observation', 'value', 'ok')] ELSE [] END AS c FROM n),
s AS (SELECT conv_id, flatten(list(c ORDER BY turn)) AS c, arg_min(text, turn) FILTER (role = 'system' AND text <> '') AS s FROM t GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN s IS NULL THEN json_object('conversations', c) ELSE json_object('conversations', c, 'system', s) END AS VARCHAR) AS value FROM s""", "fmt_sharegpt_tools")(_tool_format("sharegpt"))

# converters with tool calls, and those that take a record of few fields


def _q(c: Column | str) -> Column:
    """A JSON string."""
    return formats._quoted(c if isinstance(c, Column) else F.lit(c))


def _turn_records(spark: SparkSession, sf_dir: str, head: str, each: Callable[[Column, Column, Column], list[Column | str]], tail: str) -> DataFrame:
    """(conv_id, raw): head, then each(role, text, number) of every turn, separated by commas, then tail. The text
    of a turn has its number before it, so that no two are alike."""
    part = lambda m, i: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in each(m["role"], F.concat(F.lit("t"), i.cast("string"), F.lit(":"), m["content"]), i.cast("string"))))
    return _chats(spark, sf_dir).select("conv_id", F.concat(F.lit(head), F.array_join(F.transform("messages", part), ","), F.lit(tail)).alias("raw"))


def _turn_query(query: str, source: str, head: str, each: Callable[[Column, Column, Column], list[Column | str]], tail: str, rows: str, made_ids: bool = False) -> None:
    """With ``made_ids`` a call id that isn't null shows as 'made'. rows: SQL of what becomes of a turn, a list of structs (role, content, tool_name, tool_call_id, tool_args) from
    role, t (the text with its number), n (the number) and size (the number of turns)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        id_ = F.when(F.col("m.tool_call_id").isNotNull(), "made") if made_ids else F.col("m.tool_call_id")
        raw = _turn_records(spark, sf_dir, head, each, tail).select(F.lit(source).alias("source"), F.lit("t").alias("file"), F.col("conv_id").alias("pos"), "raw")
        made = adapters.normalized(raw, source)
        key = F.split_part("rec_key", F.lit(":"), F.lit(2)).cast("bigint").alias("conv_id")
        flat = made.select(key, "error", F.posexplode_outer("messages").alias("seq", "m"))
        return flat.select("conv_id", "error", F.col("seq").cast("bigint").alias("seq"), "m.role", "m.content", "m.tool_name", id_.alias("tool_call_id"), "m.tool_args")

    _query(f"""
WITH c AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS size, text FROM conversations),
x AS (SELECT *, 't' || n || ':' || text AS t FROM c),
l AS (SELECT conv_id, flatten(list({rows} ORDER BY n)) AS m FROM x GROUP BY conv_id),
y AS (SELECT conv_id, m, unnest(range(1, len(m) + 1)) AS k FROM l)
SELECT conv_id, CAST(NULL AS VARCHAR) AS error, k - 1 AS seq, m[k].role AS role, m[k].content AS content, m[k].tool_name AS tool_name, m[k].tool_call_id AS tool_call_id, m[k].tool_args AS tool_args FROM y""", query)(run)


def _row(role: str, content: str, name: str = "NULL", id_: str = "NULL", args: str = "NULL") -> str:
    return f"{{'role': {role}, 'content': {content}, 'tool_name': CAST({name} AS VARCHAR), 'tool_call_id': CAST({id_} AS VARCHAR), 'tool_args': CAST({args} AS VARCHAR)}}"


_ARGS = """'{"n": ' || n || '}'"""
_CALLED = """'{"tool_name": "f", "tool_args": {"n": ' || n || '}}'"""
_CALL_ROWS = f"{_row("'tool_call'", _CALLED, "'f'", "'c' || n", _ARGS)}, {_row("'tool_response'", "'r' || n", "'f'", "'c' || n")}"
_call_json = lambda n: ['{"id":"c', n, '","type":"function","function":{"name":"f","arguments":"{\\"n\\": ', n, '}"}}']
_turn_query(
    "adapt_agno_tools", "agno", '{"run_id":"r","messages":[',
    lambda role, t, n: ['{"role":', _q(role), ',"content":', _q(t), '},{"role":"assistant","content":"","tool_calls":[', *_call_json(n), ']},{"role":"tool","content":"r', n, '","tool_call_id":"c', n, '","name":"f"}'],
    '],"tools":[{"tool_name":"apart","tool_args":{},"result":"no"}]}', f"[{_row('role', 't')}, {_row("'assistant'", "''")}, {_CALL_ROWS}]",
)
_turn_query(
    "adapt_agno_tools_apart", "agno", '{"run_id":"r","messages":[{"role":"user","content":"first"},{"role":"assistant","content":"last"}],"tools":[',
    lambda role, t, n: ['{"tool_name":"f","tool_args":{"n": ', n, '},"result":', _q(t), "}"],
    "]}", f"CASE WHEN n = 0 THEN [{_row("'user'", "'first'")}] ELSE [] END || [{_row("'tool_call'", _CALLED, "'f'", args=_ARGS)}, {_row("'tool_response'", 't', "'f'")}] || CASE WHEN n = size - 1 THEN [{_row("'assistant'", "'last'")}] ELSE [] END",
)
_turn_query(
    "adapt_agno_events", "agno_events", '{"events":[',
    lambda role, t, n: ['{"event":"RunChunk","message":{"content":"c"}},{"event":"ToolDone","tool_name":"f","args":{"n": ', n, '},"result":"r', n, '"},{"event":"RunCompleted","content":', _q(t), "}"],
    "]}", f"[{_row("'tool_call'", _CALLED, "'f'", args=_ARGS)}, {_row("'tool_response'", "'r' || n", "'f'")}, {_row("'assistant'", 't')}]",
)
_turn_query(
    "adapt_autogen_tools", "autogen", '{"stop_reason":"done","messages":[',
    lambda role, t, n: ['{"source":', _q(role), ',"content":', _q(t), '},{"type":"ToolCallRequestEvent","source":"b","content":[{"id":"c', n, '","name":"f","arguments":"{\\"n\\": ', n, '}"}]},{"type":"ToolCallExecutionEvent","content":[{"call_id":"c', n, '","name":"f","content":{"content":"r', n, '"}}]}'],
    "]}", f"[{_row('role', 't')}, {_CALL_ROWS}]",
)
_turn_query(
    "adapt_autogen_stream", "autogen", '{"events":[',
    lambda role, t, n: ['{"type":"TextMessage","source":', _q(role), ',"content":', _q(t), '},{"type":"Usage","content":', n, "}"],
    "]}", f"[{_row('role', 't')}]",
)
_turn_query(
    "adapt_atomic_tools", "atomic_agents", '{"user_message":"u","system":"s","final_answer":"z","tool_calls":[',
    lambda role, t, n: ['{"name":"f","args":{"n": ', n, '},"result":{"text":', _q(t), "}}"],
    "]}", f"CASE WHEN n = 0 THEN [{_row("'system'", "'s'")}, {_row("'user'", "'u'")}] ELSE [] END || [{_row("'tool_call'", "''", "'f'", "'made'", _ARGS)}, {_row("'tool_response'", 't', "'f'", "'made'")}] || CASE WHEN n = size - 1 THEN [{_row("'assistant'", "'z'")}] ELSE [] END", made_ids=True,
)
_turn_query(
    "adapt_pydantic_tools", "pydantic_ai", '{"messages":[',
    lambda role, t, n: ['{"model_name":"m","parts":[{"part_kind":"user-prompt","content":', _q(t), '},{"part_kind":"tool-call","tool_name":"f","tool_call_id":"c', n, '","args":"{\\"n\\": ', n, '}"},{"part_kind":"tool-return","tool_name":"f","tool_call_id":"c', n, '","content":"r', n, '"},{"part_kind":"retry-prompt","tool_name":"f","tool_call_id":"c', n, '","content":"again"},{"part_kind":"retry-prompt","content":"more"},{"part_kind":"thinking","content":"no"}]}'],
    "]}", f"[{_row("'user'", 't')}, {_row("'tool_call'", "''", "'f'", "'c' || n", _ARGS)}, {_row("'tool_response'", "'r' || n", "'f'", "'c' || n")}, {_row("'tool_response'", "'again'", "'f'", "'c' || n")}, {_row("'user'", "'more'")}]",
)
_turn_query(
    "adapt_otel_tools", "opentelemetry", '{"trace_id":"x","spans":[',
    lambda role, t, n: ['{"attributes":{"openinference.span.kind":"TOOL","tool.name":"f","input.value":"{\\"n\\": ', n, '}","output.value":', _q(t), "}}"],
    "]}", f"[{_row("'user'", _ARGS)}, {_row("'assistant'", 't')}, {_row("'tool_call'", _CALLED, "'f'", args=_ARGS)}, {_row("'tool_response'", 't', "'f'")}]",
)
_turn_query(
    "adapt_agentops_events", "agentops_events", '{"events":[',
    lambda role, t, n: ['{"input":', _q(t), ',"output":"w', n, '"}'],
    "]}", f"[{_row("'user'", 't')}, {_row("'assistant'", "'w' || n")}]",
)

_ONE = {
    "adapt_crewai_kickoff": ("crewai", lambda a, z: ['{"kickoff_output":{"raw":', z, ',"tasks_output":[{"a":1}]}}'], [("assistant", "z")]),
    "adapt_crewai_event": ("crewai", lambda a, z: ['{"event":{"event_type":"CrewKickoff","input":', a, ',"output":', z, "}}"], [("user", "a"), ("assistant", "z")]),
    "adapt_agno_trace": ("agno", lambda a, z: ['{"trace":{"id":"t","spans":[{"attributes":{"input.value":', a, ',"output.value":', z, "}}]}}"], [("user", "a"), ("assistant", "z")]),
    "adapt_atomic_response": ("atomic_agents", lambda a, z: ['{"input":', a, ',"response":{"answer":', z, "}}"], [("user", "a"), ("assistant", "z")]),
    "adapt_atomic_log": ("atomic_agents", lambda a, z: ['{"event_type":"run","output":', z, "}"], [("assistant", "z")]),
}


def _one(query: str, source: str, each: Callable, rows: list[tuple[str, str]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = lambda i: _q(F.concat(F.lit("t:"), F.element_at("messages", i)["content"]))
        raw = F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in each(text(1), text(-1))))
        return _converted(_chats(spark, sf_dir).select("conv_id", raw.alias("raw")), source)

    sql = " UNION ALL ".join(f"SELECT conv_id, CAST({k} AS BIGINT) AS seq, '{role}' AS role, 't:' || {which} AS content FROM c" for k, (role, which) in enumerate(rows))
    _query(f"WITH c AS (SELECT conv_id, arg_min(text, turn) AS a, arg_max(text, turn) AS z FROM conversations GROUP BY conv_id) {sql}", query)(run)


for _name, _what in _ONE.items():
    _one(_name, *_what)

# records that are wrong, T standing for a text
_BAD: list[tuple[str, str, str]] = [
    ("openai_chat", '{"messages":[{"role":"user","content":T}]}', ""),
    ("openai_chat", '{"messages":[T,{"role":7,"content":T}]}', "openai_chat: message[0] is not an object; openai_chat: message[1] has invalid role 7"),
    ("openai_chat", '{"messages":[{"role":"assistant","content":T,"tool_calls":[3,{"id":"","type":"f","function":{"name":"f","arguments":"{}"}},{"id":"a","type":"function","function":{}},{"id":"b","type":"function","function":{"name":"f","arguments":"{"}}]}]}',
     "openai_chat: message[0].tool_calls[0] is not an object; openai_chat: message[0].tool_calls[1] missing type='function'; openai_chat: message[0].tool_calls[1] missing string 'id'; openai_chat: message[0].tool_calls[2].function missing 'name'; openai_chat: message[0].tool_calls[3].function.arguments is not a JSON string"),
    ("openai_chat", '{"messages":[{"role":"assistant","content":T,"tool_calls":[{"id":"a","type":"function","function":{"name":"f","arguments":"{}"}}]},{"role":"tool","tool_call_id":"a","content":T},{"role":"tool","content":[T]}]}',
     "openai_chat: message[2] (tool) missing 'tool_call_id'; openai_chat: message[2] (tool) content must be a string"),
    ("openai_chat", "[T]", "openai_chat: record must be an object"),
    ("openai_chat", '{"messages":T', "openai_chat: record is not JSON"),
    ("sharegpt", '{"conversations":[{"from":"human","value":T}],"system":T}', ""),
    ("sharegpt", '{"conversations":[],"a":T}', "sharegpt: 'conversations' must be a non-empty list"),
    ("sharegpt", '{"conversations":[{"from":"nobody","value":T},{"from":"system","value":T},{"from":"gpt","value":1},T,{"from":"function_call","value":"{}"}],"system":1}',
     "sharegpt: top-level 'system' must be a string; sharegpt: conversations[0] has invalid 'from' 'nobody'; sharegpt: conversations[1] uses 'system' turn; system belongs in the top-level key; sharegpt: conversations[2] 'value' must be a string; sharegpt: conversations[3] is not an object; sharegpt: conversations[4] function_call value must be JSON with a 'name'"),
    ("alpaca", '{"instruction":T,"input":"","output":T,"history":[[T,T]]}', ""),
    ("alpaca", '{"instruction":1,"output":T,"system":2,"history":[[T],[T,1]]}', "alpaca: 'instruction' must be a string; alpaca: missing required key 'input'; alpaca: optional 'system' must be a string; alpaca: history[0] must be a [user, assistant] string pair; alpaca: history[1] must be a [user, assistant] string pair"),
    ("alpaca", '{"instruction":T,"input":T,"output":T,"history":T}', "alpaca: optional 'history' must be a list"),
    ("prompt_completion", '{"prompt":T,"completion":""}', ""),
    ("prompt_completion", '{"prompt":[T]}', "prompt_completion: 'prompt' must be a string; prompt_completion: missing required key 'completion'"),
    ("preference", '{"prompt":[],"chosen":[{"role":"assistant","content":T}],"rejected":[]}', ""),
    ("preference", '{"prompt":T,"chosen":[{"role":"assistant"},T]}', "preference: 'prompt' must be a list of message objects; preference: missing required key 'rejected'; preference: chosen[0] must be a message object with role/content; preference: chosen[1] must be a message object with role/content"),
]


def _bad_query(name: str) -> None:
    own = [(raw, issues) for n, raw, issues in _BAD if n == name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, "conversations").withColumn("k", F.col("turn") % len(own))
        value = F.replace(F.get(F.array(*(F.lit(raw) for raw, _ in own)), F.col("k").cast("int")), F.lit("T"), _q(F.col("text")))
        judged = validate.judged(rows.select("conv_id", "turn", value.alias("value")), name)
        return judged.select("conv_id", "turn", F.md5("value").alias("record"), F.array_join("issues", "; ").alias("issues"))

    lists = ", ".join("'" + raw.replace("'", "''") + "'" for raw, _ in own), ", ".join("'" + i.replace("'", "''") + "'" for _, i in own)
    _query(f"SELECT conv_id, turn, md5(replace(([{lists[0]}])[turn % {len(own)} + 1], 'T', CAST(to_json(text) AS VARCHAR))) AS record, ([{lists[1]}])[turn % {len(own)} + 1] AS issues FROM conversations", f"validate_{name}_bad")(run)


for _name in validate.CHECKS:
    _bad_query(_name)


# roles and JSON

_ALIASES = "(VALUES ('human','user'),('ai','assistant'),('bot','assistant'),('gpt','assistant'),('function_call','tool_call'),('function','tool_response'),('observation','tool_response'),('tool','tool_response'),('system','system'),('user','user'),('assistant','assistant'),('tool_call','tool_call'),('tool_response','tool_response')) AS a(name, role)"
_SPELLED = ("Human", "AI ", " gpt", "function_call", "OBSERVATION", "tool", "nobody", "")


@_query(f"""
WITH r AS (SELECT role AS given FROM conversations UNION ALL SELECT unnest({list(_SPELLED)}))
SELECT given, coalesce(a.role, 'assistant') AS role, count(*) AS n FROM r LEFT JOIN {_ALIASES} ON a.name = lower(trim(given)) GROUP BY ALL""")
def normalize_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select(F.col("role").alias("given"))
    more = spark.createDataFrame([(s,) for s in _SPELLED], "given string")
    return given.unionByName(more).groupBy("given").agg(F.count("*").alias("n")).select("given", roles.normalized(F.col("given")).alias("role"), "n")


@_query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN props->>'$.k' ELSE 'p' || user_id END AS first_present,
  CASE event_id % 3 WHEN 0 THEN '7' WHEN 1 THEN nullif(props->>'$.k', '0') ELSE 'p' || user_id END AS first_truthy FROM events""")
def json_first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    j = F.when(F.col("event_id") % 3 == 0, '{"primary":null,"secondary":7}').when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"secondary":'), k, F.lit("}"))).otherwise(F.concat(F.lit('{"primary":"p'), "user_id", F.lit('","secondary":0}')))
    e = e.withColumn("j", j)
    return e.select("event_id", jsonx.first_present(F.col("j"), "primary", "secondary").alias("first_present"), jsonx.first_truthy(F.col("j"), "primary", "secondary").alias("first_truthy"))


_SHAPES = ('{"a": 1}', "{bad", '"quoted"', "12", "[1, 2]", "plain")


@_query(f"""
WITH s AS (SELECT event_id, ({list(_SHAPES)})[event_id % 6 + 1] AS s, event_id % 6 AS k FROM events)
SELECT event_id, (['object', NULL, 'string', 'number', 'array', NULL])[k + 1] AS kind,
  (['{{"a":1}}', '{{bad', 'quoted', '12', '[1,2]', 'plain'])[k + 1] AS parsed,
  (['{{"a": 1}}', '{{"value":"{{bad"}}', '{{"value":"quoted"}}', '{{"value":12}}', '{{"value":[1, 2]}}', '{{"value":"plain"}}'])[k + 1] AS wrapped,
  CAST(CASE WHEN k = 4 THEN 2 ELSE 1 END AS INTEGER) AS items FROM s""")
def jsonish_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.get(F.array(*(F.lit(x) for x in _SHAPES)), (F.col("event_id") % 6).cast("int"))
    e = _table(spark, sf_dir, "events").select("event_id", s.alias("s"))
    return e.select("event_id", jsonx.kind(F.col("s")).alias("kind"), jsonx.jsonish(F.col("s")).alias("parsed"), jsonx.wrapped(F.col("s")).alias("wrapped"), F.size(jsonx.as_list(F.col("s"))).alias("items"))


@_query("""
SELECT event_id, '{"k":"' || (props->>'$.k') || '","zero":"0"' || CASE WHEN event_id % 2 = 0 THEN ',"user":"' || user_id || '"' ELSE '' END || '}' AS value FROM events""")
def compact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("null")
    j = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"none":null,"empty":[],"dict":{},"zero":0,"user":'), user, F.lit("}"))
    return _table(spark, sf_dir, "events").select("event_id", jsonx.compacted(j).alias("value"))


# relational operators

_DEDUP_SQL = """
SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) = 1"""


@_query(_DEDUP_SQL)
def dedup_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return conv.deduplicated_rows(e, "user_id", "at", "event_type", "props").select("user_id", "event_id")


@_query("SELECT user_id, count(*) AS n, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id)) AS ids FROM (" + _DEDUP_SQL.replace("event_id FROM", "event_id, ts FROM") + ") GROUP BY user_id")
def dedup_messages_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within the rows of transcripts."""
    e = _table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).withColumn("id", F.col("event_id").cast("string"))
    m = conv.deduplicated(conv.collected(e, "user_id", "at", "event_type", "props", tool_call_id="id"))
    ids = F.transform("messages", lambda x: x["tool_call_id"])
    return m.select("user_id", F.size(ids).cast("bigint").alias("n"), F.md5(F.array_join(ids, ",")).alias("ids"))


@_query("""
SELECT user_id, segment, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM (
  SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM events)
GROUP BY user_id, segment""")
def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = conv.segments(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")
    return e.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


_PAIR_SQL = """
WITH e AS (SELECT user_id, event_id, ts, event_type = 'click' AS c FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT *, sum(CASE WHEN c THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bal FROM e),
m AS (SELECT *, least(min(bal) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS low FROM b),
o AS (SELECT *, NOT c AND low < coalesce(lag(low) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS orphan FROM m),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o WHERE NOT c AND NOT orphan),
q AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o WHERE c)
SELECT r.user_id, q.event_id AS call, r.event_id AS result FROM r JOIN q USING (user_id, k)
UNION ALL SELECT user_id, -1, event_id FROM o WHERE orphan"""


@_query(_PAIR_SQL)
def tool_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results to calls by the formatter's fold over each user's transcript."""
    e = _table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    call = F.col("event_type") == "click"
    m = F.struct(F.when(call, "tool_call").otherwise("tool_response").alias("kind"), F.lit("t").alias("name"), F.when(call, F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("event"))
    chats = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", m.alias("m")))).alias("x")).select("user_id", F.transform("x", lambda x: x["m"]).alias("m"))
    rows = chats.withColumn("ids", formats.paired(F.col("m"))).select("user_id", F.explode(F.arrays_zip("m", "ids")).alias("z")).where("z.ids is not null")
    return rows.select("user_id", F.when(F.col("z.ids") == "call_unknown", "-1").otherwise(F.col("z.ids")).cast("bigint").alias("call"), F.col("z.m.event").alias("result"))


@_query(_PAIR_SQL)
def tool_pairing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by running counts over rows, for transcripts of any length."""
    e = _table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    return conv.fifo_pairs(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", "event_id").fillna(-1, ["call"])


@_query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, props,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(event_id % 23 AS VARCHAR) END AS id, event_type <> 'purchase' AS req FROM events),
g AS (SELECT user_id, id, min(seq) FILTER (req) AS pos, arg_max(event_type, seq) FILTER (req) AS method,
  arg_max(props, seq) FILTER (req) AS request, arg_max(props, seq) FILTER (NOT req) AS response FROM e WHERE id IS NOT NULL GROUP BY ALL),
u AS (SELECT user_id, id, pos, method, request, response, 0 AS late FROM g WHERE pos IS NOT NULL
  UNION ALL SELECT user_id, NULL, seq, event_type, props, NULL, 1 FROM e WHERE id IS NULL AND req)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY late, pos) - 1 AS INTEGER) AS place, id, method, request, response FROM u""")
def mcp_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("seq", F.expr("row_number() over (partition by user_id order by ts, event_id)"))
    e = e.withColumn("id", F.when(F.col("event_type").isin("click", "view", "purchase"), (F.col("event_id") % 23).cast("string"))).withColumn("method", F.when(F.col("event_type") != "purchase", F.col("event_type")))
    return conv.rpc_pairs(e, "user_id", "seq", "id", "method", "props")


@_query("""
SELECT conv_id, CASE WHEN role = 'assistant' THEN 'output' ELSE 'input' END AS direction, turn + 8 AS idx, role, text AS content, CAST(NULL AS VARCHAR) AS name FROM conversations""")
def otel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    head = F.concat(F.lit("llm."), F.when(F.col("role") == "assistant", "output").otherwise("input"), F.lit("_messages."), F.col("turn") + 8, F.lit(".message."))
    pairs = F.array(F.struct(F.concat(head, F.lit("role")).alias("name"), F.col("role").alias("value")), F.struct(F.concat(head, F.lit("content")).alias("name"), F.col("text").alias("value")), F.struct(F.lit("other").alias("name"), F.lit("x").alias("value")))
    flat = c.select("conv_id", F.explode(pairs).alias("a")).select("conv_id", "a.name", "a.value")
    return conv.flattened_messages(flat, "conv_id", "name", "value")


@_query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, props, event_id FROM events)
SELECT user_id, arg_max(props, seq) FILTER (event_type = 'click') AS prompt_tokens, arg_max(props, seq) FILTER (event_type = 'view') AS completion_tokens,
  arg_min(event_type, seq) FILTER (event_id % 3 = 0) AS model FROM e GROUP BY user_id""")
def usage_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    last = conv.last_values(e, "user_id", at, prompt_tokens=F.when(F.col("event_type") == "click", F.col("props")), completion_tokens=F.when(F.col("event_type") == "view", F.col("props")))
    first = conv.first_truthy_values(e, "user_id", at, model=F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(""))
    return last.join(first, "user_id")


@_query("""
WITH e AS (SELECT *, event_type = 'purchase' AS done FROM events),
s AS (SELECT *, CAST(coalesce(sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM e)
SELECT CAST(user_id AS VARCHAR) AS session, segment, count(DISTINCT (event_type, props)) AS n, bool_or(done) AS complete FROM s GROUP BY user_id, segment""")
def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments to sessions, in batch; the stream's result is compared with this in tests."""
    e = _table(spark, sf_dir, "events")
    parts = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.array(conv.message(F.col("event_type"), F.col("props"))).alias("messages"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("iterations"), F.lit(1).alias("max_iter"))
    return sessions.merge_batch(parts).select("session", "segment", F.size("messages").cast("bigint").alias("n"), "complete")


# validation and rejects


@_query("""
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN conv_id % 4 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_issues, CASE conv_id % 4
  WHEN 1 THEN 'openai_chat: message[0] has invalid role ''bot''' WHEN 2 THEN 'openai_chat: ''messages'' must be a non-empty list'
  WHEN 3 THEN 'openai_chat: message[' || n || '] (tool) references unknown tool_call_id ''x''' END AS issue FROM c""")
def validate_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a record, three of four with a fault put in."""
    kind = F.col("conv_id") % 4
    turn = lambda role, content, id_=None: F.struct(role.alias("role"), content.alias("content"), (F.lit(id_)).cast("string").alias("tool_call_id"))
    turns = F.transform("messages", lambda m, i: turn(F.when((kind == 1) & (i == 0), "bot").otherwise(m["role"]), m["content"]))
    turns = F.when(kind == 2, F.slice(turns, 1, 0)).when(kind == 3, F.concat(turns, F.array(turn(F.lit("tool"), F.lit("y"), "x")))).otherwise(turns)
    made = _chats(spark, sf_dir).select("conv_id", F.to_json(F.struct(turns.alias("messages"))).alias("value"))
    return validate.judged(made, "openai_chat").select("conv_id", F.size("issues").alias("n_issues"), F.get("issues", F.lit(0)).alias("issue"))


@_query("SELECT f AS format, (SELECT count(DISTINCT conv_id) FROM conversations) AS records, CAST(0 AS BIGINT) AS invalid FROM unnest(['openai_chat', 'sharegpt', 'alpaca', 'prompt_completion', 'preference']) AS t(f)")
def validate_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatters make, judged by the validators."""
    chats = _chats(spark, sf_dir)
    judged = [validate.judged(formats.formatted(chats, n).select(F.lit(n).alias("format"), "value"), n).select("format", F.size("issues").alias("n")) for n in formats.FORMATS]
    each = reduce(DataFrame.unionByName, judged)
    return each.groupBy("format").agg(F.count("*").alias("records"), F.sum((F.col("n") > 0).cast("bigint")).alias("invalid"))


@_query("""
SELECT doc_id, doc_id % 3 = 0 AS accepted, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_messages, CASE WHEN doc_id % 3 = 2 THEN 'not a JSON object' WHEN doc_id % 3 = 1 THEN 'not JSON' END AS why FROM documents""")
def skip_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: a third prompts, a third plain text, a third lists."""
    d = _table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("prompt"), F.col("lang").alias("completion")))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("{"), "text")).otherwise(F.to_json(F.array("text")))
    rows = d.select(F.lit("prompt_completion").alias("source"), F.lit("t").alias("file"), F.col("doc_id").alias("pos"), raw.alias("raw"))
    good, bad = scans.split(rows)
    made = adapters.normalized(good, "prompt_completion")
    key = F.split_part("rec_key", F.lit(":"), F.lit(2)).cast("bigint").alias("doc_id")
    kept = engine.accepted(made, skip_invalid=True).select(key, F.lit(True).alias("accepted"), F.size("messages").alias("n_messages"), F.lit(None).cast("string").alias("why"))
    return kept.unionByName(bad.select(F.col("pos").alias("doc_id"), F.lit(False).alias("accepted"), F.lit(0).alias("n_messages"), F.col("error").alias("why")))


# sources and sinks


def _folder(spark: SparkSession) -> str:
    """In the shared folder; a temporary one only where that is unset and all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, shared[7:], ignore_errors=True)
    return shared.rstrip("/") + f"/jsonl-{uuid.uuid4().hex}"


def _stored(gz: str, append: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records, path = formats.formatted(_chats(spark, sf_dir), "prompt_completion"), _folder(spark) + gz
        for mode in "wa" if append else "w":
            storage.write_jsonl(records, path, mode)
        back = storage.read_jsonl(spark, path)
        return back.groupBy("value").agg(F.count("*").alias("n"))

    return run


_STORED_SQL = f"WITH t AS ({_TURNS}) SELECT CAST(json_object('prompt', coalesce(u[1], ''), 'completion', coalesce(a[-1], '')) AS VARCHAR) AS value, count(*) * N AS n FROM t GROUP BY 1"
_query(_STORED_SQL.replace("* N", "* 1"), "jsonl_roundtrip")(_stored("", False))
_query(_STORED_SQL.replace("* N", "* 2"), "jsonl_gzip_append_roundtrip")(_stored(".jsonl.gz", True))


@_query("SELECT 'format' AS kind, unnest(['openai_chat', 'sharegpt', 'alpaca', 'prompt_completion', 'preference']) AS name")
def info_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.info(spark).where("kind = 'format'")


@_query("""
SELECT d.doc_id, d.lang, CAST(json_object('prompt', d.lang, 'completion', d.text) AS VARCHAR) AS value
FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic = 0)""")
def sft_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of good quality as records: a semi-join with the labels."""
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    d = _table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi")
    return d.select("doc_id", "lang", F.to_json(F.struct(F.col("lang").alias("prompt"), F.col("text").alias("completion"))).alias("value"))
