"""Relational operators over message and event rows: collect, dedup, segment, pair, pivot, last value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import normalized
from ..schema import FIELDS


def message(role: Column, content: Column, **fields: Column) -> Column:
    values = {"role": role, "content": content} | fields
    return F.struct(*(values.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS))


def collected(rows: DataFrame, key: str, seq: str, role: str, content: str, **fields: str) -> DataFrame:
    """(key, messages) in the order of seq: one shuffle on the key."""
    m = F.struct(F.col(seq).alias("seq"), message(F.col(role), F.col(content), **{k: F.col(v) for k, v in fields.items()}).alias("m"))
    ordered = F.array_sort(F.collect_list(m))
    return rows.groupBy(key).agg(F.transform(ordered, lambda x: x["m"]).alias("messages"))


def exploded(df: DataFrame, key: str) -> DataFrame:
    """(key, seq, role, content, ...) of every message."""
    return df.select(key, F.posexplode("messages").alias("seq", "m")).select(key, "seq", "m.*")


def deduplicated(df: DataFrame) -> DataFrame:
    """Messages of an interaction without those that repeat an earlier role, content, tool name and arguments.

    Arguments compare as JSON: keys in any order. One row in, one row out, no shuffle.
    """
    sign = lambda m: F.struct(m["role"], m["content"], m["tool_name"], F.coalesce(F.to_json(F.try_parse_json(m["tool_args"])), m["tool_args"]))
    # signatures sorted with their places: the first of equal ones stays, so no message is compared with all before it
    ranked = F.array_sort(F.transform("messages", lambda m, i: F.struct(F.to_json(sign(m)).alias("s"), i.alias("i"))))
    df = df.withColumn("__s", ranked)
    firsts = F.filter("__s", lambda x, k: (k == 0) | (F.get("__s", k - 1)["s"] != x["s"]))
    places = F.array_sort(F.transform(firsts, lambda x: x["i"]))
    return df.withColumn("messages", F.transform(places, lambda i: F.get("messages", i))).drop("__s")


def deduplicated_rows(rows: DataFrame, key: str, seq: str, *signature: str) -> DataFrame:
    """The same for message rows, where an interaction may be too long for one row."""
    w = Window.partitionBy(key, *signature).orderBy(seq)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def segments(rows: DataFrame, key: str, order: list[str], ends: Column, out: str = "segment") -> DataFrame:
    """Rows with the number of completed segments before them: a row that ends one belongs to it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(ends.cast("long")).over(w), F.lit(0).cast("long")))


def last_values(rows: DataFrame, key: str, order: Column, **values: Column) -> DataFrame:
    """For each key and name the last value that is not null."""
    return rows.groupBy(key).agg(*(F.max_by(v, F.when(v.isNotNull(), order)).alias(n) for n, v in values.items()))


def first_truthy_values(rows: DataFrame, key: str, order: Column, **values: Column) -> DataFrame:
    """For each key and name the first value that is neither null nor empty."""
    return rows.groupBy(key).agg(*(F.min_by(v, F.when(v.isNotNull() & (v != ""), order)).alias(n) for n, v in values.items()))


def rpc_pairs(rows: DataFrame, key: str, seq: str, id_: str, method: str, payload: str) -> DataFrame:
    """(key, place, id, method, request, response): requests with their responses, then notifications.

    Of equal ids the last request and response count, at the place of the first request; responses
    without a request are left out. One shuffle: requests and responses are grouped together.
    """
    is_request = F.col(method).isNotNull()
    at = F.col(seq)
    by_id = rows.where(F.col(id_).isNotNull()).groupBy(key, F.col(id_).cast("string").alias("id")).agg(
        F.min(F.when(is_request, at)).alias("at"),
        F.max_by(method, F.when(is_request, at)).alias("method"),
        F.max_by(payload, F.when(is_request, at)).alias("request"),
        F.max_by(payload, F.when(~is_request, at)).alias("response"),
    ).where("at is not null").withColumn("late", F.lit(0))
    notes = rows.where(F.col(id_).isNull() & is_request).select(key, F.lit(None).cast("string").alias("id"), at.alias("at"), F.col(method).alias("method"), F.col(payload).alias("request"), F.lit(None).cast("string").alias("response"), F.lit(1).alias("late"))
    w = Window.partitionBy(key).orderBy("late", "at")
    return by_id.unionByName(notes).withColumn("place", F.row_number().over(w) - 1).select(key, "place", "id", "method", "request", "response")


_FLAT = r"(?:llm\.)?(input|output)_messages\.(\d+)\.message\.(role|content|name)$"


def flattened_messages(attributes: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, direction, idx, role, content): messages spelled out as one attribute for each field.

    Input comes before output, an index counts as a number; fields of one message are put together by one
    grouping.
    """
    a = attributes.withColumn("__d", F.regexp_extract(name, _FLAT, 1)).where("__d <> ''")
    a = a.withColumn("__i", F.regexp_extract(name, _FLAT, 2).cast("long")).withColumn("__f", F.regexp_extract(name, _FLAT, 3))
    pick = lambda f: F.max(F.when(F.col("__f") == f, F.col(value)))
    out = a.groupBy(key, F.col("__d").alias("direction"), F.col("__i").alias("idx")).agg(pick("role").alias("role"), F.coalesce(pick("content"), F.lit("")).alias("content"), pick("name").alias("name"))
    return out.withColumn("role", normalized(F.col("role")))


def fifo_pairs(rows: DataFrame, key: str, order: list[str], is_call: Column, id_: str) -> DataFrame:
    """(key, call, result): results matched with the oldest open call, by running counts; a result with no
    open call has none. For tool names that don't differ; transcripts in one row use formats.paired()."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = rows.withColumn("__c", is_call).withColumn("__b", F.sum(F.when(is_call, 1).otherwise(-1)).over(w))
    low = step.withColumn("__low", F.least(F.min("__b").over(w), F.lit(0)))
    prior = F.coalesce(F.lag("__low").over(Window.partitionBy(key).orderBy(*order)), F.lit(0))
    low = low.withColumn("__orphan", ~F.col("__c") & (F.col("__low") < prior))
    numbered = low.withColumn("__k", F.sum(F.when(~F.col("__orphan"), 1)).over(w.partitionBy(key, "__c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    calls = F.max(F.when(F.col("__c"), F.col(id_)))
    hits = F.max(F.when(~F.col("__c"), F.col(id_)))
    matched = numbered.where("not __orphan").groupBy(key, "__k").agg(calls.alias("call"), hits.alias("result")).where("result is not null")
    orphans = numbered.where("__orphan").select(key, F.lit(None).cast("bigint").alias("call"), F.col(id_).alias("result"))
    return matched.select(key, "call", "result").unionByName(orphans)
