"""JSON text as Columns: presence, kinds and lookups that keep null apart from absent.

Values stay JSON text, so key order and number spelling are those of the input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def not_blank(c: Column) -> Column:
    """Whether text holds anything but white space of any script; null is blank."""
    return F.coalesce(c.rlike(_SPACE.replace("[", "[^", 1)), F.lit(False))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def path(*names: str) -> str:
    return "$" + "".join("['" + n.replace("'", "\\'") + "']" for n in names)


def has(j: Column, name: str) -> Column:
    """Whether an object has the key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(j), name), F.lit(False))


def get(j: Column, *names: str) -> Column:
    """The value at a path: text unquoted, others as JSON text, null for null or absent."""
    return F.get_json_object(j, path(*names))


def first_present(j: Column, *names: str) -> Column:
    """The value of the first key that exists, even if it is null."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(has(j, n), get(j, n)).otherwise(out)
    return out


def first_truthy(j: Column, *names: str) -> Column:
    """The first value that is neither null, empty, zero nor false."""
    return F.coalesce(*(F.when(truthy(get(j, n)), get(j, n)) for n in names), F.lit(None).cast("string"))


def truthy(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", "false", "0", "0.0", "[]", "{}")


def kind(j: Column) -> Column:
    """object, array, string, number, boolean, null; null if the text isn't JSON."""
    shape = F.schema_of_variant(F.try_parse_json(j))
    named = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string")
    return named.when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").when(shape.isNotNull(), "number")


def elements(j: Column) -> Column:
    """The elements of a JSON array, each as JSON text (strings unquoted)."""
    return F.from_json(j, "array<string>")


def as_list(j: Column) -> Column:
    """null: nothing; an array: its elements; anything else: itself."""
    return F.when(j.isNull() | (j == "null"), F.array().cast("array<string>")).when(F.ltrim(j).startswith("["), F.coalesce(elements(j), F.array(j))).otherwise(F.array(j))


def jsonish(c: Column) -> Column:
    """Text that looks like JSON and is JSON, in compact form; else the text."""
    looks = F.substring(stripped(c), 1, 1).isin("[", "{", '"')
    return F.when(looks & F.try_parse_json(c).isNotNull(), F.coalesce(F.get_json_object(stripped(c), "$"), c)).otherwise(c)


def wrapped(j: Column) -> Column:
    """An object as it is; null stays; anything else becomes {"value": it}."""
    return F.when(kind(j) == "object", j).when(j.isNotNull(), F.concat(F.lit('{"value":'), F.when(kind(j).isNotNull(), j).otherwise(F.to_json(F.array(j)).substr(F.lit(2), F.length(F.to_json(F.array(j))) - 2)), F.lit("}")))


def compacted(j: Column) -> Column:
    """An object without its null, {} and [] values."""
    kept = F.map_filter(F.from_json(j, "map<string,string>"), lambda _, v: v.isNotNull() & ~v.isin("{}", "[]"))
    return F.to_json(kept)
