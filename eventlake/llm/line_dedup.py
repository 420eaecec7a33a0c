"""Line dedup: lines that many documents share stay in one of them.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, ref

#: Code points of a key, and documents that hold it, from which its lines go.
MIN_CHARS, MIN_DOCS = 40, 5
#: Copies of each common key, dealt by document, so that no task joins all documents of one key.
SALTS = 32
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(ref(text), F.lit("")), "\n", -1)


def _row_key(text: str) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(ref(text), F.lit("")))


def common_lines(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(occurrences, common): every line that is long enough, and the keys that ``min_docs`` documents hold.

    Only the keys' 128-bit hashes move.  Counting goes by (key, document) first,
    so a key that a third of all documents hold is dealt over all tasks, and a
    task passes on one row for each key.
    """
    lines = df.where(F.col("doc_id").isNotNull()).select(
        "doc_id", _row_key(text).alias("__el_row"), F.posexplode(_lines(text)).alias("pos", "line")
    )
    key = F.trim(F.col("line"), F.lit(_BLANK))
    lines = lines.where(F.char_length("line") >= min_chars).withColumn("key", key).where(F.char_length("key") >= min_chars)
    folded = fold_ascii(F.col("key"))
    occurrences = lines.select("doc_id", "__el_row", "pos", F.xxhash64(folded).alias("h"), F.xxhash64(F.lit(7), folded).alias("g"))
    common = (
        occurrences.groupBy("h", "g", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h", "g")
        .agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )
    return occurrences, common


def drop_common_lines(
    df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", salts: int = SALTS
) -> DataFrame:
    """df with ``text`` without common lines, and n_lines, n_dropped (long).

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased;
    a key of at least ``min_chars`` code points in at least ``min_docs`` distinct
    doc_ids loses its lines except in the largest doc_id that holds it (there
    all of them stay).  Null and empty texts are one empty line; a null text
    comes back empty.  Rows without a doc_id keep all lines and don't count as
    documents.  Rows that repeat a doc_id are one document for the count.
    """
    occurrences, common = common_lines(df, min_chars, min_docs, text)
    dealt = common.select("h", "g", "keeper", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dropped = (
        occurrences.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .join(dealt, ["h", "g", "salt"])
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("__el_id"), F.col("__el_row").alias("__el_of"))
        .agg(F.collect_set("pos").alias("__el_drop"))
    )
    kept = [c for c in df.columns if c.lower() not in {text.lower(), "n_lines", "n_dropped"}]
    joined = df.withColumn("__el_row", _row_key(text)).join(
        dropped, (F.col("doc_id") == F.col("__el_id")) & (F.col("__el_row") == F.col("__el_of")), "left"
    )
    split, drop = _lines(text), F.coalesce(F.col("__el_drop"), F.array().cast("array<int>"))
    staying = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), drop)
    rebuilt = F.when(F.size(drop) == 0, F.coalesce(ref(text), F.lit(""))).otherwise(
        F.array_join(F.transform(staying, lambda i: F.get(F.col("__el_lines"), i)), "\n")
    )
    out = joined.withColumn("__el_lines", split).select(
        *[ref(c) for c in kept],
        rebuilt.alias("__el_text"),
        F.size(split).cast("long").alias("n_lines"),
        F.size(drop).cast("long").alias("n_dropped"),
    )
    order = [F.col("__el_text").alias(c) if c.lower() == text.lower() else ref(c) for c in df.columns if c.lower() not in {"n_lines", "n_dropped"}]
    return out.select(*order, "n_lines", "n_dropped")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_common_lines(df.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


#: The contract in DuckDB's SQL.
SQL = r"""
WITH lines AS (
  SELECT doc_id, pos - 1 AS pos, line FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
