"""The canonical shapes, as Spark types. JSON values are kept as text."""

from __future__ import annotations

MESSAGE = "struct<role:string,content:string,tool_name:string,tool_args:string,tool_call_id:string,tool_result:string>"
MESSAGES = f"array<{MESSAGE}>"
FIELDS = ("role", "content", "tool_name", "tool_args", "tool_call_id", "tool_result")
#: Metadata that has a column of its own; the rest is in ``metadata``, as a JSON object.
TEXT_VIEWS = ("model", "provider", "run_id", "thread_id", "trace_id")
JSON_VIEWS = ("agent", "extra", "instantiation", "token_usage", "tools")
INTERACTION = (
    f"rec_key string, sub_pos int, id string, source_framework string, session_id string, timestamp string, messages {MESSAGES}, "
    + ", ".join(f"{c} string" for c in TEXT_VIEWS + JSON_VIEWS)
    + ", spans array<struct<kind:string,payload:string>>, metadata string, error string"
)
RAW = "source string, file string, pos bigint, raw string"
