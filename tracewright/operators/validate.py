"""Structural checks of training records: JSON text to a list of issues. An empty list is a valid record.

Records come from anywhere, so a string must be told from a number and an absent key from null; the
checks run on parsed values within Arrow batches. They say nothing about the quality of the text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

Check = Callable[[dict], Iterator[str]]
_CHAT_ROLES = frozenset(("system", "user", "assistant", "tool"))
_SENDERS = frozenset(("human", "gpt", "system", "function_call", "observation", "tool"))


class InvalidRecord(ValueError):
    pass


def _text(v: Any) -> bool:
    return isinstance(v, str)


def _named(v: Any) -> bool:
    return isinstance(v, str) and v != ""


def _parsed(v: Any) -> Any:
    """The JSON value in a string; an Exception instance if there is none."""
    try:
        return json.loads(v) if isinstance(v, str) else ValueError()
    except ValueError as e:
        return e


def _call_issues(where: str, call: Any, announced: set[str]) -> Iterator[str]:
    if not isinstance(call, dict):
        yield f"{where} is not an object"
        return
    if call.get("type") != "function":
        yield f"{where} missing type='function'"
    if _named(call.get("id")):
        announced.add(call["id"])
    else:
        yield f"{where} missing string 'id'"
    f = call.get("function")
    if not isinstance(f, dict) or not _named(f.get("name")):
        yield f"{where}.function missing 'name'"
    elif isinstance(_parsed(f.get("arguments")), Exception):
        yield f"{where}.function.arguments is not a JSON string"


def _openai_chat(r: dict) -> Iterator[str]:
    turns = r.get("messages")
    if not isinstance(turns, list) or not turns:
        yield "'messages' must be a non-empty list"
        return
    announced: set[str] = set()
    for k, m in enumerate(turns):
        at = f"message[{k}]"
        if not isinstance(m, dict):
            yield f"{at} is not an object"
        elif not _text(m.get("role")) or m["role"] not in _CHAT_ROLES:
            yield f"{at} has invalid role {m.get('role')!r}"
        elif m["role"] == "assistant":
            for c, call in enumerate(m.get("tool_calls") or []):
                yield from _call_issues(f"{at}.tool_calls[{c}]", call, announced)
        elif m["role"] == "tool":
            id_ = m.get("tool_call_id")
            if not _named(id_):
                yield f"{at} (tool) missing 'tool_call_id'"
            elif id_ not in announced:
                yield f"{at} (tool) references unknown tool_call_id {id_!r}"
            if not _text(m.get("content")):
                yield f"{at} (tool) content must be a string"


def _sharegpt(r: dict) -> Iterator[str]:
    turns = r.get("conversations")
    if not isinstance(turns, list) or not turns:
        yield "'conversations' must be a non-empty list"
        return
    if not _text(r.get("system", "")):
        yield "top-level 'system' must be a string"
    for k, t in enumerate(turns):
        at = f"conversations[{k}]"
        if not isinstance(t, dict):
            yield f"{at} is not an object"
            continue
        who, value = t.get("from"), t.get("value")
        if not _text(who) or who not in _SENDERS:
            yield f"{at} has invalid 'from' {who!r}"
        if who == "system":
            yield f"{at} uses 'system' turn; system belongs in the top-level key"
        if not _text(value):
            yield f"{at} 'value' must be a string"
        elif who == "function_call" and not (isinstance(p := _parsed(value), dict) and "name" in p):
            yield f"{at} function_call value must be JSON with a 'name'"


def _texts(*keys: str) -> Check:
    def check(r: dict) -> Iterator[str]:
        for k in keys:
            if k not in r:
                yield f"missing required key {k!r}"
            elif not _text(r[k]):
                yield f"{k!r} must be a string"

    return check


def _alpaca(r: dict) -> Iterator[str]:
    yield from _texts("instruction", "input", "output")(r)
    if not _text(r.get("system", "")):
        yield "optional 'system' must be a string"
    pairs = r.get("history", [])
    if not isinstance(pairs, list):
        yield "optional 'history' must be a list"
        return
    for k, pair in enumerate(pairs):
        if not isinstance(pair, list) or [*map(type, pair)] != [str, str]:
            yield f"history[{k}] must be a [user, assistant] string pair"


def _preference(r: dict) -> Iterator[str]:
    for key in ("prompt", "chosen", "rejected"):
        if key not in r:
            yield f"missing required key {key!r}"
        elif not isinstance(r[key], list):
            yield f"{key!r} must be a list of message objects"
    for key in ("chosen", "rejected"):
        own = r.get(key)
        for k, m in enumerate(own if isinstance(own, list) else []):
            if not isinstance(m, dict) or not {"role", "content"} <= m.keys():
                yield f"{key}[{k}] must be a message object with role/content"


CHECKS: dict[str, Check] = {"openai_chat": _openai_chat, "sharegpt": _sharegpt, "alpaca": _alpaca, "prompt_completion": _texts("prompt", "completion"), "preference": _preference}


def validate_record(record: Any, name: str) -> list[str]:
    if name not in CHECKS:
        raise ValueError(f"no validator for {name!r}; there are {', '.join(CHECKS)}")
    if not isinstance(record, dict):
        return [f"{name}: record must be an object"]
    return [f"{name}: {issue}" for issue in CHECKS[name](record)]


def is_valid(record: Any, name: str) -> bool:
    return not validate_record(record, name)


def assert_valid(record: Any, name: str) -> None:
    if issues := validate_record(record, name):
        raise InvalidRecord("; ".join(issues))


def judged(df: DataFrame, name: str, value: str = "value") -> DataFrame:
    """df with ``issues``, array<string>, of the record in a column of JSON text."""
    if name not in CHECKS:
        raise ValueError(f"no validator for {name!r}; there are {', '.join(CHECKS)}")

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(value).to_pylist():
                p = _parsed(v)
                out.append([f"{name}: record is not JSON"] if isinstance(p, Exception) else validate_record(p, name))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], names=[*batch.schema.names, "issues"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("issues", ArrayType(StringType()))]))


def split(df: DataFrame, name: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``issues``)."""
    all_ = judged(df, name, value)
    return all_.where(F.size("issues") == 0).drop("issues"), all_.where(F.size("issues") > 0)


def asserted(df: DataFrame, name: str, value: str = "value") -> DataFrame:
    """df, whose execution fails at the first invalid record."""
    stop = F.when(F.size("issues") > 0, F.raise_error(F.array_join("issues", "; ")).cast("string")).otherwise(F.col(value))
    return judged(df, name, value).withColumn(value, stop).drop("issues")
