"""Chat templates as black boxes: where each turn ends up in the rendered text.

A template is any function from a list of (role, text) to a string. It is called on the successive
prefixes of a conversation. If the output for k turns begins with the output for k-1 turns, what was
added is turn k's span. If it does not, the template has rewritten history: the row says so, and at
which character the outputs part; its span is then what lies after that. Only the last two outputs are
held. A template may end its output with a fixed closing that more turns push on; ``closing`` takes it
off before comparing, if it is there.

Defined cases: turns are ordered by turn, role, text, nulls first; a null role or text counts as empty;
a null turn is a turn; a null conversation id makes no conversation; equal rows are turns each; a turn
that adds nothing has an empty span. If the template raises an error for a prefix, the turn's start, end and
rewrites are null, and the next turn that is rendered is compared with the last output there was (with the
empty text if there was none). An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, number

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]


def chatml(turns: Turns) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def instruct(turns: Turns) -> str:
    """System text inside the next user turn; user and assistant turns between instruction marks."""
    out, system = [], ""
    for role, text in turns:
        if role == "system":
            system = f"<<SYS>>\n{text}\n<</SYS>>\n\n"
        elif role == "user":
            out.append(f"<s>[INST] {system}{text} [/INST]")
            system = ""
        else:
            out.append(f" {text} </s>")
    return "".join(out)


def last_answer_only(turns: Turns) -> str:
    """Shortens every assistant turn but the last to its first line, as templates that drop reasoning do."""
    last = max((k for k, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
    return "".join(f"<{role}>{text.split(chr(10))[0] if role == 'assistant' and k != last else text}</{role}>" for k, (role, text) in enumerate(turns))


def closed(turns: Turns) -> str:
    """A document that ends with a closing mark however many turns it has."""
    return "[" + "".join(f"{role}: {text}\n" for role, text in turns) + "]"


#: name: (template, closing)
TEMPLATES: dict[str, tuple[Template, str]] = {"chatml": (chatml, ""), "closed": (closed, "]"), "instruct": (instruct, ""), "last_answer_only": (last_answer_only, "")}

_TEXT = """
SELECT conv_id, row_number() OVER w - 1 AS k, coalesce(role, '') AS role, coalesce(text, '') AS text,
  count(*) OVER (PARTITION BY conv_id) AS n
FROM conversations WHERE conv_id IS NOT NULL
WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)"""
#: The spans of append-only templates are running lengths; rewriting is found from the rule that causes it.
ORACLE_SQL = f"""
WITH t AS ({_TEXT}),
system AS (
  SELECT *, CASE WHEN role = 'user' THEN last_value(CASE WHEN role IN ('system', 'user') THEN CASE WHEN role = 'system' THEN text ELSE '' END END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS before,
    coalesce(last_value(CASE WHEN role IN ('system', 'user') THEN role END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before_role FROM t),
added AS (
  SELECT conv_id, k, role, 'chatml' AS template, 0 AS lead, 23 + length(role) + length(text) + 1 AS len FROM t
  UNION ALL SELECT conv_id, k, role, 'closed', 1, length(role) + length(text) + 3 FROM t
  UNION ALL SELECT conv_id, k, role, 'instruct', 0, CASE WHEN role = 'system' THEN 0
    WHEN role = 'user' THEN 18 + length(text) + CASE WHEN before_role = 'system' THEN 19 + length(before) ELSE 0 END
    ELSE 6 + length(text) END FROM system),
plain AS (
  SELECT conv_id, template, k, role, lead + sum(len) OVER w - len AS a, lead + sum(len) OVER w AS b, false AS rewrites
  FROM added WINDOW w AS (PARTITION BY conv_id, template ORDER BY k)),
short AS (
  SELECT *, length(role) * 2 + 5 + length(text) AS whole,
    length(role) * 2 + 5 + length(CASE WHEN role = 'assistant' THEN string_split(text, chr(10))[1] ELSE text END) AS cut,
    max(CASE WHEN role = 'assistant' THEN k END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM t),
sums AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM short),
places AS (
  SELECT s.*, CASE WHEN s.last IS NOT NULL AND s.role = 'assistant' AND p.whole > p.cut THEN true ELSE false END AS rewrites,
    p.upto AS p_upto, p.whole AS p_whole, p.cut AS p_cut, p.role AS p_role
  FROM sums s LEFT JOIN sums p ON p.conv_id = s.conv_id AND p.k = s.last),
rewritten AS (
  SELECT conv_id, 'last_answer_only' AS template, k, role,
    CASE WHEN rewrites THEN p_upto - length(p_role) - 3
         ELSE upto - cut + coalesce(CASE WHEN role <> 'assistant' THEN p_whole - p_cut END, 0) END AS a,
    upto - cut + whole + coalesce(CASE WHEN role <> 'assistant' THEN p_whole - p_cut END, 0) AS b, rewrites FROM places)
SELECT conv_id, template, CAST(k AS INTEGER) AS turn, role, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", rewrites
FROM (SELECT * FROM plain UNION ALL SELECT * FROM rewritten)"""


def spans(turns: Turns, template: Template, closing: str = "") -> list[tuple[int | None, int | None, bool | None]]:
    """(start, end, rewrites) of each turn in the output for the turns up to it."""
    out, last = [], ""
    for k in range(len(turns) + 1):
        try:
            now = template(turns[:k])
        except Exception:  # any: the template is a black box, and may refuse what isn't a whole conversation
            if k:
                out.append((None, None, None))
            continue
        if closing and now.endswith(closing):
            now = now[: -len(closing)]
        if k and now.startswith(last):
            out.append((len(last), len(now), False))
        elif k:
            out.append((len(os.path.commonprefix([last, now])), len(now), True))
        last = now
    return out


def _rendered(templates: dict[str, tuple[Template, str]]):
    def run(batches):
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                said = [(t["role"] or "", t["text"] or "") for t in turns]
                for name, (template, closing) in templates.items():
                    rows += [(conv, name, k, said[k][0], *s) for k, s in enumerate(spans(said, template, closing))]
            cols = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "template", "turn", "role", "start", "end", "rewrites"])

    return run


def turn_spans(conversations: DataFrame, templates: dict[str, tuple[Template, str]] = TEMPLATES) -> DataFrame:
    """(conv_id, template, turn, role, start, end, rewrites) of every turn, counted from 0, in each template."""
    c = conversations
    src = c.select(number(c, "conv_id").alias("conv_id"), F.struct(*(column(c, n).alias(n) for n in ("turn", "role", "text"))).alias("t")).where("conv_id is not null")
    whole = src.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(_rendered(templates), "conv_id long, template string, turn int, role string, start long, end long, rewrites boolean")
