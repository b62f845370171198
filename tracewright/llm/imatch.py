"""I-Match fingerprints: hashes of the terms whose document frequency is neither high nor low.

A term is a run of letters and digits in lower case. Terms are kept whose inverse document frequency,
ln(documents / documents with the term), lies in ``[IDF_LOW, IDF_HIGH]``. A document's fingerprint 0
hashes its distinct kept terms in order; fingerprints 1 to ``LEXICONS`` do so with a random subset of
the lexicon, from which each term is missing with a chance of 1 in ``DROP``. Two documents that share
any fingerprint are duplicates: a document that differs in a few terms still agrees with a copy where
the subset misses these.

Document frequencies count all documents. Each task counts within its blocks; sums are shuffled by
term. A lexicon whose terms have up to ``LEXICON_CHARS`` characters goes to every worker; a larger one is joined by
shuffle, with the same result.

A document with fewer than ``MIN_TERMS`` kept terms has a fingerprint 0 of all its distinct terms, or of its
text if it has none, which can't equal one of kept terms, and no others: so exact copies among such documents
are found too.

Defined cases: a null id, a null, empty or blank text has no fingerprint; a subset that leaves fewer than
``MIN_TERMS`` terms has none (it is null); rows that share an id count and are fingerprinted each, and same_as
is the least over them. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spooled, column, number

IDF_LOW, IDF_HIGH = 2.0, 7.0
LEXICONS = 4
DROP = 5
MIN_TERMS = 4
LEXICON_CHARS = 16_000_000
TERM = r"[\p{L}\p{N}]+"
_COLUMNS = ", ".join(f"fp_{k} string" for k in range(LEXICONS + 1))
ORACLE_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, text, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS terms
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
flat AS (SELECT r, doc_id, unnest(terms) AS term FROM docs),
lexicon AS (
  SELECT term FROM flat GROUP BY term
  HAVING count(*) BETWEEN (SELECT count(*) FROM docs) * exp(-7.0) AND (SELECT count(*) FROM docs) * exp(-2.0)),
kept AS (
  SELECT r, doc_id, term, k FROM flat JOIN lexicon USING (term), unnest(range(5)) AS t(k)
  WHERE k = 0 OR CAST(('0x' || substr(md5(k || ':' || term), 1, 4)) AS INTEGER) % 5 <> 0),
size AS (SELECT r, count(*) FILTER (k = 0) AS n FROM kept GROUP BY r),
every AS (SELECT r, string_agg(term, ' ' ORDER BY encode(term)) AS terms FROM flat GROUP BY r),
prints AS (
  SELECT r, doc_id, k, md5(string_agg(term, ' ' ORDER BY encode(term))) AS fp
  FROM kept GROUP BY r, doc_id, k HAVING count(*) >= 4
  UNION ALL
  SELECT r, doc_id, 0, md5('* ' || coalesce(every.terms, '#' || md5(text))) FROM docs LEFT JOIN size USING (r) LEFT JOIN every USING (r)
  WHERE coalesce(n, 0) < 4 AND regexp_matches(text, '[^\t-\r\x1c-\x20\x85\p{Z}]')),
low AS (SELECT k, fp, min(doc_id) AS first FROM prints GROUP BY k, fp)
SELECT p.doc_id, CAST(coalesce(any_value(size.n), 0) AS INTEGER) AS n_terms,
  max(fp) FILTER (k = 0) AS fp_0, max(fp) FILTER (k = 1) AS fp_1, max(fp) FILTER (k = 2) AS fp_2,
  max(fp) FILTER (k = 3) AS fp_3, max(fp) FILTER (k = 4) AS fp_4, min(l.first) AS same_as
FROM prints p JOIN low l USING (k, fp) LEFT JOIN size ON size.r = p.r GROUP BY p.r, p.doc_id"""


def in_lexicon(k: int, term: str) -> bool:
    """Whether random lexicon k has the term; lexicon 0 has all."""
    return not k or int(hashlib.md5(f"{k}:{term}".encode()).hexdigest()[:4], 16) % DROP != 0


def _terms(text: str, found) -> set[str]:
    return set(found(text.lower()))


def _counted(batches):
    import regex

    found, counts = regex.compile(TERM).findall, {}
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for term in _terms(text, found):
                counts[term] = counts.get(term, 0) + 1
        if len(counts) > 500_000:
            yield _batch(counts)
            counts = {}
    yield _batch(counts)


def _batch(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])


def lexicon(src: DataFrame) -> DataFrame:
    """(term, lacks) of the band; lacks as of lacking(). src: (id, text), no nulls."""
    n = src.count()
    freq = src.select("text").mapInArrow(_counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    own = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), "term")), 1, 4), 16, 10).cast("int") % DROP == 0
    lacks = sum((F.when(own(k), 1 << k).otherwise(0) for k in range(1, LEXICONS + 1)), F.lit(0))
    return freq.where(F.col("df").between(n * math.exp(-IDF_HIGH), n * math.exp(-IDF_LOW))).select("term", lacks.alias("lacks"))


def prints(terms: list[str], lacks: dict[str, int]) -> list[str | None]:
    """Fingerprints of sorted terms. lacks: by term, a bit for each lexicon without it."""
    out = []
    for k in range(LEXICONS + 1):
        own = [t for t in terms if not lacks[t] >> k & 1]
        out.append(hashlib.md5(" ".join(own).encode()).hexdigest() if len(own) >= MIN_TERMS else None)
    return out


def _all_terms(text: str, found) -> list[str]:
    """Sorted terms of a text; a mark of the text itself if it has none; nothing if it is blank."""
    return sorted(_terms(text, found)) or (["#" + hashlib.md5(text.encode()).hexdigest()] if text.strip() else [])


def whole_print(terms: list[str]) -> list[str | None]:
    """Fingerprints of a document with too few kept terms, from all its sorted terms. No term has a star."""
    return [hashlib.md5(("* " + " ".join(terms)).encode()).hexdigest(), *[None] * LEXICONS]


def lacking(term: str) -> int:
    return sum(1 << k for k in range(1, LEXICONS + 1) if not in_lexicon(k, term))


def _out(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, *fps = zip(*rows, strict=True) if rows else [()] * (LEXICONS + 3)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), *(pa.array(x, pa.string()) for x in fps)], names=["doc_id", "n_terms", *(f"fp_{k}" for k in range(LEXICONS + 1))])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon_chars: int = LEXICON_CHARS) -> DataFrame:
    """(doc_id, n_terms, fp_0, ...) of each row whose text isn't blank; n_terms counts the kept terms."""
    src = docs.select(number(docs, id_col).alias("id"), column(docs, text_col).alias("text")).where("id is not null and text is not null")
    band = Spooled(lexicon(src))
    schema = f"doc_id long, n_terms int, {_COLUMNS}"
    if (band.df.agg(F.sum(F.length("term") + 8)).first()[0] or 0) <= lexicon_chars:
        shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["lacks"] for r in band.df.toLocalIterator()})

        def run(batches):
            import regex

            found, lacks = regex.compile(TERM).findall, shared.value
            for batch in batches:
                rows = []
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    terms = sorted(_terms(text, found) & lacks.keys())
                    if len(terms) >= MIN_TERMS:
                        rows.append((key, len(terms), *prints(terms, lacks)))
                    elif own := _all_terms(text, found):
                        rows.append((key, len(terms), *whole_print(own)))
                yield _out(rows)

        return src.mapInArrow(run, schema)

    def pairs(batches):
        import regex

        found = regex.compile(TERM).findall
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms = _all_terms(text, found)
                row = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(terms), pa.int64()), pa.array([row] * len(terms), pa.int64()), pa.array(terms, pa.string())], names=["id", "row", "term"])

    def listed(batches):
        for batch in batches:
            rows = []
            for key, terms, others, copies in zip(*(batch.column(c).to_pylist() for c in ("id", "terms", "others", "copies")), strict=True):
                if len(terms) >= MIN_TERMS:
                    terms.sort()
                    rows += [(key, len(terms), *prints(terms, {t: lacking(t) for t in terms}))] * copies
                else:
                    rows += [(key, len(terms), *whole_print(sorted(terms + others)))] * copies
            yield _out(rows)

    flat = src.mapInArrow(pairs, "id long, row long, term string").groupBy("id", "row", "term").agg(F.count("*").alias("copies"))
    marked = flat.join(band.df.select("term", F.lit(True).alias("kept")), "term", "left")
    listed_if = lambda test, name: F.collect_list(F.when(test, F.col("term"))).alias(name)
    kept = marked.groupBy("id", "row").agg(listed_if(F.col("kept").isNotNull(), "terms"), listed_if(F.col("kept").isNull(), "others"), F.max("copies").alias("copies"))
    return kept.mapInArrow(listed, schema)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon_chars: int = LEXICON_CHARS) -> DataFrame:
    """fingerprints() and same_as, the smallest doc_id that shares one (the document's own if no other does)."""
    made = Spooled(fingerprints(docs, id_col, text_col, lexicon_chars)).df
    names = [f"fp_{k}" for k in range(LEXICONS + 1)]
    each = made.select("doc_id", F.posexplode(F.array(*names)).alias("k", "fp")).where("fp is not null")
    low = each.groupBy("k", "fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    best = each.join(low, ["k", "fp"]).groupBy("doc_id").agg(F.min("first").alias("first"))
    return made.join(best, "doc_id", "left").withColumn("same_as", F.coalesce("first", "doc_id")).drop("first")
