"""Training records from canonical messages, as Column expressions.

Every formatter takes a DataFrame with ``messages`` and returns it with one more column, JSON text. None
shuffles: a transcript is one row. Null fields are left out of the JSON, as an absent key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import get, not_blank
from ..schema import MESSAGES


def _role(*names: str) -> Callable[[Column], Column]:
    return lambda m: m["role"].isin(*names)


def _said(m: Column) -> Column:
    """An assistant turn with text."""
    return (m["role"] == "assistant") & not_blank(m["content"])


def _content(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


def call_name(m: Column) -> Column:
    c = m["content"]
    return F.coalesce(F.nullif(m["tool_name"], F.lit("")), F.nullif(get(c, "tool_name"), F.lit("")), F.nullif(get(c, "name"), F.lit("")), F.lit("unknown_tool"))


def call_args(m: Column) -> Column:
    c = m["content"]
    empty = lambda x: F.when(~x.isin("", "{}", "[]", "0", "false"), x)
    return F.coalesce(m["tool_args"], empty(get(c, "tool_args")), get(c, "arguments"), F.lit("{}"))


def result_text(m: Column) -> Column:
    return F.coalesce(m["tool_result"], m["content"], F.lit(""))


def _staged(df: DataFrame, key: Column) -> DataFrame:
    """Messages with resolved tool fields: kind, text, name, args, id. An absent call id is made from the key and place."""
    made = lambda i: F.concat(F.lit("call_"), F.substring(F.sha2(F.concat_ws(":", key.cast("string"), i.cast("string")), 256), 1, 8))
    one = lambda m, i: F.struct(
        m["role"].alias("kind"),
        F.when(m["role"] == "tool_response", result_text(m)).otherwise(_content(m)).alias("text"),
        F.when(m["role"] == "tool_call", call_name(m)).otherwise(m["tool_name"]).alias("name"),
        F.when(m["role"] == "tool_call", call_args(m)).alias("args"),
        F.when(m["role"] == "tool_call", F.coalesce(F.nullif(m["tool_call_id"], F.lit("")), made(i))).otherwise(F.nullif(m["tool_call_id"], F.lit(""))).alias("id"),
    )
    return df.withColumn("__m", F.transform(F.coalesce("messages", F.array().cast(MESSAGES)), one))


_PENDING = "array<struct<id:string,name:string>>"


def _without(pending: Column, at: Column) -> Column:
    """pending less its element at a place that counts from 0; -1 leaves all."""
    return F.filter(pending, lambda _, i: i != at)


def paired(messages: Column) -> Column:
    """For each message the id that a tool result answers, by a fold with the calls still open.

    A result's own id comes first and closes that call; then the oldest open call of the same name; then
    the oldest open call; then ``call_unknown``.
    """
    start = F.struct(F.array().cast(_PENDING).alias("open"), F.array().cast("array<string>").alias("ids"))

    def place(pending: Column, test: Callable[[Column], Column]) -> Column:
        hits = F.filter(F.transform(pending, lambda p, i: F.when(test(p), i)), lambda i: i.isNotNull())
        return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(-1))

    def step(state: Column, m: Column) -> Column:
        open_, ids = state["open"], state["ids"]
        by_id = place(open_, lambda p: p["id"] == m["id"])
        by_name = place(open_, lambda p: p["name"] == m["name"])
        oldest = F.when(F.size(open_) > 0, F.lit(0)).otherwise(F.lit(-1))
        at = F.when(m["id"].isNotNull(), by_id).when(by_name >= 0, by_name).otherwise(oldest)
        answer = F.coalesce(m["id"], F.get(open_, at)["id"], F.lit("call_unknown"))
        answer = F.when(m["id"].isNull() & (at < 0), F.lit("call_unknown")).otherwise(answer)
        more = F.concat(open_, F.array(F.struct(m["id"].alias("id"), m["name"].alias("name"))))
        return F.struct(
            F.when(m["kind"] == "tool_call", more).when(m["kind"] == "tool_response", _without(open_, at)).otherwise(open_).alias("open"),
            F.concat(ids, F.array(F.when(m["kind"] == "tool_response", answer))).alias("ids"),
        )

    return F.aggregate(messages, start, lambda s, m: step(s, m), lambda s: s["ids"])


def _safe_paired(messages: Column) -> Column:
    calls = F.exists(messages, lambda m: m["kind"] == "tool_response")
    return F.when(calls, paired(messages)).otherwise(F.transform(messages, lambda _: F.lit(None).cast("string")))


def chat_messages(df: DataFrame, key: Column | None = None, strict: bool = False) -> DataFrame:
    """df with ``chat``: the OpenAI message list. strict drops results that answer no call."""
    df = _staged(df, key if key is not None else F.xxhash64(F.to_json("messages")))
    df = df.withColumn("__ids", _safe_paired(F.col("__m")))
    # for each message the place where the run of calls that begins there ends
    last = F.size("__m")
    stops = F.filter(F.transform("__m", lambda m, i: F.when(m["kind"] != "tool_call", i)), lambda i: i.isNotNull())
    df = df.withColumn("__stops", stops)
    run_end = lambda i: F.coalesce(F.try_element_at(F.filter("__stops", lambda s: s >= i), F.lit(1)), last)
    call = lambda m: F.struct(m["id"].alias("id"), F.lit("function").alias("type"), F.struct(m["name"].alias("name"), m["args"].alias("arguments")).alias("function"))
    calls = lambda i: F.transform(F.slice("__m", i + 1, F.greatest(run_end(i) - i, F.lit(0))), call)
    no_calls = F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")
    kind_at = lambda i: F.coalesce(F.get("__m", i)["kind"], F.lit(""))

    def turn(role: str, content: Column, tool_calls: Column = no_calls, answers: Column | None = None) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), tool_calls.alias("tool_calls"), (answers if answers is not None else F.lit(None).cast("string")).alias("tool_call_id"))

    def one(m: Column, i: Column) -> Column:
        before, after = F.when(i > 0, kind_at(i - 1)).otherwise(F.lit("")), kind_at(i + 1)
        answer = F.get("__ids", i)
        result = turn("tool", m["text"], answers=answer)
        if strict:
            result = F.when(answer != "call_unknown", result)
        return (
            F.when(m["kind"] == "system", turn("system", m["text"]))
            .when(m["kind"] == "user", turn("user", m["text"]))
            .when((m["kind"] == "assistant") & (after == "tool_call"), turn("assistant", F.when(not_blank(m["text"]), m["text"]).otherwise(F.lit("")), calls(i + 1)))
            .when((m["kind"] == "assistant") & not_blank(m["text"]), turn("assistant", m["text"]))
            .when((m["kind"] == "tool_call") & ~before.isin("tool_call", "assistant"), turn("assistant", F.lit(""), calls(i)))
            .when(m["kind"] == "tool_response", result)
        )

    out = df.withColumn("chat", F.filter(F.transform("__m", one), lambda t: t.isNotNull()))
    return out.drop("__m", "__ids", "__stops")


def _schemas(df: DataFrame) -> Column:
    """Tool schemas of the metadata as a list of JSON texts; null if there are none."""
    if "metadata" not in df.columns:
        return F.lit(None).cast("array<string>")
    found = F.from_json(get(F.col("metadata"), "tool_schemas"), "array<string>")
    return F.when(F.size(found) > 0, found)


def _spliced(record: Column, key: str, json: Column) -> Column:
    """A JSON object with one more member, if there is a value for it."""
    return F.when(json.isNull(), record).otherwise(F.concat(F.regexp_replace(record, r"\}$", ""), F.lit(f',"{key}":'), json, F.lit("}")))


def openai_chat(df: DataFrame, out: str = "value", key: Column | None = None, strict: bool = False) -> DataFrame:
    df = chat_messages(df, key, strict)
    tools = F.concat(F.lit("["), F.array_join(_schemas(df), ","), F.lit("]"))
    return df.withColumn(out, _spliced(F.to_json(F.struct(F.col("chat").alias("messages"))), "tools", tools)).drop("chat")


def sharegpt(df: DataFrame, out: str = "value") -> DataFrame:
    def one(m: Column) -> Column:
        turn = lambda who, value: F.struct(who.alias("from"), value.alias("value"))
        call = F.concat(F.lit('{"name": '), _quoted(call_name(m)), F.lit(', "arguments": '), F.when(F.try_parse_json(call_args(m)).isNotNull(), call_args(m)).otherwise(_quoted(call_args(m))), F.lit("}"))
        return (
            F.when(m["role"] == "user", turn(F.lit("human"), _content(m)))
            .when(_said(m), turn(F.lit("gpt"), m["content"]))
            .when(m["role"] == "tool_call", turn(F.lit("function_call"), call))
            .when(m["role"] == "tool_response", turn(F.lit("observation"), result_text(m)))
            .when(~m["role"].isin("assistant", "system"), turn(m["role"], _content(m)))
        )

    systems = F.filter("messages", lambda m: (m["role"] == "system") & (F.length(m["content"]) > 0))
    turns = F.filter(F.transform("messages", one), lambda t: t.isNotNull())
    plain = F.transform(_schemas(df), lambda s: F.coalesce(get(s, "function"), s))
    tools = F.concat(F.lit("["), F.array_join(plain, ", "), F.lit("]"))
    return df.withColumn(out, F.to_json(F.struct(turns.alias("conversations"), F.try_element_at(systems, F.lit(1))["content"].alias("system"), tools.alias("tools"))))


def _quoted(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return text.substr(F.lit(2), F.length(text) - 2)


def _users(of: str = "messages") -> Column:
    return F.transform(F.filter(of, _role("user")), _content)


def _answers(of: str = "messages") -> Column:
    return F.transform(F.filter(of, _said), lambda m: m["content"])


def alpaca(df: DataFrame, out: str = "value", system_as_instruction: bool = False) -> DataFrame:
    df = df.withColumn("__u", _users()).withColumn("__a", _answers())
    n = F.least(F.size("__u"), F.size("__a"))
    history = F.when(n > 1, F.slice(F.zip_with("__u", "__a", lambda u, a: F.array(u, a)), F.lit(1), F.greatest(n - 1, F.lit(0))))
    systems = F.filter("messages", _role("system"))
    system = F.when(F.size(systems) > 0, _content(F.try_element_at(systems, F.lit(1))))
    user = F.coalesce(F.try_element_at("__u", F.lit(-1)), F.lit(""))
    answer = F.coalesce(F.try_element_at("__a", F.lit(-1)), F.lit(""))
    as_it = F.lit(system_as_instruction) & system.isNotNull()
    record = F.struct(
        F.when(as_it, system).otherwise(user).alias("instruction"), F.when(as_it, user).otherwise(F.lit("")).alias("input"), answer.alias("output"),
        F.when(~as_it, system).alias("system"), history.alias("history"),
    )
    return df.withColumn(out, F.to_json(record)).drop("__u", "__a")


def prompt_completion(df: DataFrame, out: str = "value") -> DataFrame:
    first = F.coalesce(F.try_element_at(_users(), F.lit(1)), F.lit(""))
    last = F.coalesce(F.try_element_at(_answers(), F.lit(-1)), F.lit(""))
    return df.withColumn(out, F.to_json(F.struct(first.alias("prompt"), last.alias("completion"))))


def preference(df: DataFrame, out: str = "value", key: Column | None = None, rejected: str = "", require_rejected: bool = False, strict: bool = False) -> DataFrame:
    """The last answer with text is chosen, what is before it the prompt; rejected is a placeholder unless
    given. require_rejected leaves out rows that would have only the placeholder."""
    df = chat_messages(df, key, strict)
    hits = F.filter(F.transform("chat", lambda t, i: F.when((t["role"] == "assistant") & (F.length(t["content"]) > 0), i)), lambda i: i.isNotNull())
    at = F.try_element_at(hits, F.lit(-1))
    df = df.withColumn("__at", at)
    record = F.struct(
        F.when(F.col("__at").isNull(), F.col("chat")).otherwise(F.slice("chat", F.lit(1), F.coalesce("__at", F.lit(0)))).alias("prompt"),
        F.when(F.col("__at").isNull(), F.slice("chat", 1, 0)).otherwise(F.slice("chat", F.coalesce("__at", F.lit(0)) + 1, F.lit(1))).alias("chosen"),
        F.array(F.struct(F.lit("assistant").alias("role"), F.lit(rejected).alias("content"))).alias("rejected"),
    )
    if require_rejected and not rejected:
        df = df.where(F.lit(False))
    return df.withColumn(out, F.to_json(record)).drop("chat", "__at")


def canonical(df: DataFrame, out: str = "value") -> DataFrame:
    cols = [c for c in ("id", "messages", "source_framework", "timestamp", "session_id", "metadata") if c in df.columns]
    return df.withColumn(out, F.to_json(F.struct(*cols)))


FORMATS: dict[str, Callable[..., DataFrame]] = {"openai_chat": openai_chat, "sharegpt": sharegpt, "alpaca": alpaca, "prompt_completion": prompt_completion, "preference": preference}
#: Not among the default five: the interaction itself.
EXTRA_FORMATS = {"canonical": canonical}


class UnknownFormat(ValueError):
    pass


def available_formats() -> list[str]:
    return list(FORMATS)


def formatted(df: DataFrame, name: str, out: str = "value", **options) -> DataFrame:
    made = (FORMATS | EXTRA_FORMATS).get(name)
    if made is None:
        raise UnknownFormat(f"no format {name!r}; there are {', '.join(FORMATS)}")
    return made(df, out=out, **options)
