"""Operator 6: line dedup by distinct-site spread.

One HyperLogLog sketch of sites for each line hash, merged by aggregation. Lines whose estimate is near the
threshold (four standard errors and one) get an exact distinct count; those clearly above are taken as they
are. A line that is spread over ``sites`` sites or more is boilerplate: the document of the smallest doc_id
that has it keeps it, so that one copy of a copied document stays whole, and all others lose it.

Lines are what lies between line feeds; lines without a visible character are never boilerplate. A null
site counts as none. Null texts stay null, empty ones empty. Rows that share a doc_id count as one document: each keeps the lines
that this id keeps and loses those it loses. Texts are whole, of any length; other columns are passed on.
Line hashes are 96 bits (XXH64 and Murmur3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize, unused

SITES, LOG_K, KEPT = 10, 12, "__lines_kept"


def _split(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def line_keys(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc_id, site, key): each document's different lines with a visible character."""
    visible = F.filter(F.array_distinct(_split("text")), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]", "")) > 0)
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), F.explode(F.transform(visible, _key)).alias("key"))
    return materialize(lines, "line-keys")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(key, first): hashes of lines on at least ``sites`` sites, and the smallest doc_id that has them."""
    band = 1 + 4 * 1.04 / 2 ** (LOG_K / 2) * sites
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.min("doc_id").alias("first"))
    spread = spread.select("key", "first", F.hll_sketch_estimate("sketch").alias("about")).where(F.col("about") >= sites - band)
    spread = materialize(spread, "line-spread")
    near = spread.where(F.col("about") <= sites + band).select("key", "first")
    exact = lines.select("key", "site").join(near, "key").distinct().groupBy("key").agg(F.count("site").alias("n"), F.first("first").alias("first"))
    return spread.where(F.col("about") > sites + band).select("key", "first").union(exact.where(F.col("n") >= sites).select("key", "first"))


def removals(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """(doc_id, gone): the hashes of the lines that each document loses, sorted."""
    lines = line_keys(docs, site)
    spread = boilerplate(lines, sites)
    return lines.join(spread.hint("merge"), "key").where("doc_id != first").groupBy("doc_id").agg(F.sort_array(F.collect_list("key")).alias("gone"))


def _among(keys: Column, key: Column) -> Column:
    """Whether a sorted array has a key; longer arrays are halved until one place is left."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(keys, middle) <= key
        return F.struct(F.when(below, middle).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(middle).alias("hi"))

    turns = F.sequence(F.lit(1), F.ceil(F.log2(F.size(keys))).cast("int") + 1)
    found = F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(keys).alias("hi")), halve, lambda s: F.get(keys, s["lo"]) == key)
    return F.when(F.size(keys) <= 16, F.array_contains(keys, key)).otherwise(found)


def _kept(gone: Column) -> Column:
    lines = F.transform(_split("text"), lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    kept = F.transform(F.filter(lines, lambda x: ~_among(gone, x["key"])), lambda x: x["line"])
    return F.when(gone.isNull(), _split("text")).otherwise(kept)


def with_kept(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` with KEPT, the array of each document's remaining lines (null for a null text)."""
    ident, lost = (unused(x, docs.columns) for x in ("line_id", "line_gone"))
    gone = removals(docs, site, sites).toDF(ident, lost)
    out = docs.join(gone, docs["doc_id"].cast("long") == F.col(ident), "left")
    return out.withColumn(KEPT, _kept(F.col(lost))).drop(ident, lost)


def dedup(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """``docs`` with texts without boilerplate; documents that lose all their lines go."""
    out = with_kept(docs, site, sites).where(F.col("text").isNull() | (F.size(KEPT) > 0)).withColumn("text", F.array_join(KEPT, "\n"))
    return out.select(docs.columns)


def report(docs: DataFrame) -> DataFrame:
    lines = F.coalesce(F.size(_split("text")), F.lit(0)).cast("long")
    out = with_kept(docs).select("doc_id", lines.alias("n_lines"), F.coalesce(F.size(KEPT), F.lit(0)).cast("long").alias("n_kept"), F.md5(F.coalesce(F.array_join(KEPT, "\n"), F.lit(""))).alias("kept_md5"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_removed"), "kept_md5")


REPORT_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
b AS (
  SELECT line, min(doc_id) AS first FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.line) FILTER (b.first <> l.doc_id) AS n_removed,
         md5(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (b.line IS NULL OR b.first = l.doc_id), '')) AS kept_md5
  FROM l LEFT JOIN b ON l.line = b.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_md5, md5('')) AS kept_md5
FROM documents d LEFT JOIN k USING (doc_id)
"""
