"""Role names as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonx import stripped

ROLES = ("system", "user", "assistant", "tool_call", "tool_response")
ALIASES = {
    "human": "user",
    "ai": "assistant", "bot": "assistant", "gpt": "assistant",
    "function_call": "tool_call",
    "function": "tool_response", "observation": "tool_response", "tool": "tool_response",
}
#: The senders of a local ShareGPT file, matched as they are.
SENDERS = {"human": "user", "gpt": "assistant", "function_call": "tool_call", "observation": "tool_response"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def normalized(role: Column, default: str = "assistant") -> Column:
    """One of ROLES: aliases resolved without regard to case and outer white space, unknown names as default."""
    low = F.lower(stripped(role))
    return F.coalesce(F.try_element_at(_map(ALIASES | {r: r for r in ROLES}), low), F.lit(default))


def of_sender(role: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(SENDERS), role), role)
