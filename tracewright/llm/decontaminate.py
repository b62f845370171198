"""Benchmark passages in documents, by one Aho-Corasick automaton.

Questions and answers are normalised: lower case, runs of white space and ASCII punctuation become one
space. Each distinct one of at least ``MIN_WORDS`` words is a pattern of one automaton, between spaces,
so that it matches whole words only. A document is normalised likewise and scanned once; the places
found are mapped back to characters of the original text. The benchmark is what is kept out of the
training data, so it is small beside the corpus: its automaton goes to every worker while its patterns have at
most ``AUTOMATON_CHARS`` characters in all; those of a larger one are dealt to several automata, each with a
scan of its own, so that no task and no step of the driver holds more than one.

Defined cases: a null id, a null or empty text match nothing; null and short items are no patterns;
items that normalise alike are reported as the smallest item_id; matches may overlap; a passage that
occurs twice is reported twice; rows that share an id are scanned each, and equal matches of one id
are reported once. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spooled, column, number
from .kernels import NOT_ALNUM, batch_blocks, buffers

MIN_WORDS = 6
AUTOMATON_CHARS = 4_000_000
#: The k-th match begins after the k texts between matches and the k-1 matches before it.
ORACLE_SQL = r"""
WITH items AS (
  SELECT p, min(item_id) AS item_id FROM (
    SELECT item_id, trim(regexp_replace(lower(text), '[\x00-/:-@\[-`{-\x7f]+', ' ', 'g')) AS p FROM benchmark
    WHERE item_id IS NOT NULL AND text IS NOT NULL)
  WHERE len(string_split(p, ' ')) >= 6 GROUP BY p),
shapes AS (
  SELECT item_id, p, '(?i)(?:^|[\x00-/:-@\[-`{-\x7f])' || replace(p, ' ', '[\x00-/:-@\[-`{-\x7f]+')
    || '(?:$|[\x00-/:-@\[-`{-\x7f])' AS shape FROM items),
norm AS (
  SELECT doc_id, text, ' ' || trim(regexp_replace(lower(text), '[\x00-/:-@\[-`{-\x7f]+', ' ', 'g')) || ' ' AS n
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
hit AS (
  SELECT doc_id, item_id, regexp_extract_all(text, shape) AS m, string_split_regex(text, shape) AS gap
  FROM norm JOIN shapes ON contains(n, ' ' || p || ' ')),
each AS (
  SELECT doc_id, item_id, m[k] AS m,
    list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS pos
  FROM hit, unnest(range(1, len(m) + 1)) AS t(k))
SELECT DISTINCT doc_id, item_id,
  CAST(pos + CASE WHEN regexp_matches(m, '^[\x00-/:-@\[-`{-\x7f]') THEN 1 ELSE 0 END AS BIGINT) AS start,
  CAST(pos + length(m) - CASE WHEN regexp_matches(m, '[\x00-/:-@\[-`{-\x7f]$') THEN 1 ELSE 0 END AS BIGINT) AS "end"
FROM each"""
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[NOT_ALNUM] = 32


def normalised(data: np.ndarray, offsets: np.ndarray):
    """Bytes of a block with ASCII in lower case and one space for each run of other ASCII, a space
    at either end of each document; where each document begins (n+1 numbers); for each byte its place
    in the block. Letters beyond ASCII must be in lower case already."""
    n, docs = len(data), len(offsets) - 1
    x = _LOWER[data]
    gap = x == 32
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    keep = ~gap
    keep[1:] |= ~gap[:-1] & ~first[1:n]  # the first of a run of gaps, not at a document's start
    at = np.flatnonzero(keep)
    begin = np.searchsorted(at, offsets)
    size = np.diff(begin)
    # a space before each document and, unless it ends with one, after it
    ends_open = np.zeros(docs, bool)
    some = size > 0
    ends_open[some] = x[at[begin[1:][some] - 1]] != 32
    total = size + 1 + ends_open
    cut = np.append(0, np.cumsum(total))
    out = np.full(int(cut[-1]), 32, np.uint8)
    place = np.empty(int(cut[-1]), np.int64)
    place[cut[:-1]] = offsets[:-1]
    place[cut[1:] - 1] = offsets[1:]
    to = np.arange(len(at)) + np.repeat(cut[:-1] + 1 - begin[:-1], size)
    out[to], place[to] = x[at], at
    return out, cut, place


def normal(text: str | None) -> str:
    data, offsets = buffers(pc.utf8_lower(pa.array([text or ""])))
    return normalised(data, offsets)[0].tobytes().decode()


def _normal_items(min_words: int):
    def run(batches):
        for batch in batches:
            ps = [normal(x) for x in batch.column("text").to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(ps, pa.string())], names=["item_id", "p"])
            yield out.filter(pa.array([len(p.split()) >= min_words for p in ps], pa.bool_()))

    return run


def patterns(benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(p, item_id): each distinct normalised item that is long enough."""
    items = benchmark.select(number(benchmark, "item_id").alias("item_id"), column(benchmark, "text").alias("text")).where("item_id is not null and text is not null")
    return Spooled(items.mapInArrow(_normal_items(min_words), "item_id long, p string").groupBy("p").agg(F.min("item_id").alias("item_id"))).df


def automaton(found: list[tuple[str, int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, item in found:
        a.add_word(p, (item, len(p)))
    a.make_automaton()
    return a


def _scanned(shared):
    def run(batches):
        machine = automaton(shared.value)
        # lower case is letter by letter here, so it moves no character
        for batch, i, j, low, offsets in batch_blocks(batches, "text", lower=True):
            text, cut, place = normalised(low, offsets)
            doc, item, start, end = [], [], [], []
            for k in range(j - i):
                norm = text[cut[k] : cut[k + 1]]
                hits = list(machine.iter(norm.tobytes().decode()))
                if not hits:
                    continue
                byte = place[cut[k] : cut[k + 1]][np.flatnonzero((norm & 0xC0) != 0x80)] - offsets[k]  # by character
                chars = np.cumsum((low[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)
                for e, (which, n) in hits:
                    doc.append(i + k)
                    item.append(which)
                    start.append(int(chars[byte[e - n + 2]]) - 1)
                    end.append(int(chars[byte[e - 1]]))
            ids = batch.column("id").take(pa.array(doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (item, start, end))], names=["doc_id", "item_id", "start", "end"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end) of every passage; characters of the original text, end exclusive."""
    found, spark = patterns(benchmark, min_words), docs.sparkSession
    parts = -(-(found.agg(F.sum(F.length("p"))).first()[0] or 0) // chars)
    src = docs.select(number(docs, id_col).alias("id"), column(docs, text_col).alias("text")).where("id is not null and text is not null")
    schema, out = "doc_id long, item_id long, start long, end long", None
    for k in range(parts):
        own = [tuple(r) for r in found.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == k).select("p", "item_id").collect()]
        if not own:
            continue
        each = src.mapInArrow(_scanned(spark.sparkContext.broadcast(own)), schema)
        out = each if out is None else out.unionByName(each)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_items) of the documents that hold a passage."""
    return matches(docs, benchmark, id_col, text_col).groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"))
