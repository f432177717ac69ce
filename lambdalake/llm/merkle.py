"""Operator 13: Merkle manifest of a data set, by a block engine on DuckDB.

A leaf is the SHA-256 of a row's fields, each with its length. The leaves of a source, by doc_id, form a tree of runs of
three; the sources' roots form one more. Spark numbers the leaves and deals them out in blocks that are aligned to whole
subtrees (``3 ** LEVELS`` leaves): in each task DuckDB builds all levels of a few thousand leaves at a time by ordered
``string_agg`` and ``sha256``, and writes each leaf's inner path. The roots of the blocks are the leaves of the next round, until
a source has one node; paths from there on are joined to the blocks. No task holds more than one batch of blocks.

A path is text: for each level, from the leaf up, the run that the node is in, with ``?`` in its place; levels are separated by
blanks. ``fold`` goes up a path on the JVM.

A null field is ``-``; empty texts are ``0:``. A null source is a source of its own and the first; null doc_ids come first in their
source and are never tampered with. Repeated rows are leaves side by side; rows that share a doc_id are ordered by their leaves.
An empty table has no rows. Texts are whole, of any length; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import FOLDERS, materialize, numbered, partitions, settle

#: Children of a node; levels of a block; leaves that the engine takes at a time; hex digits of a digest.
FAN, LEVELS, BATCH, HEX = 3, 7, 1 << 15, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a row; fields can be given other values by name."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    steps = F.filter(F.split(path, " "), lambda x: x != "")
    return F.aggregate(steps, start, lambda h, x: F.sha2(F.replace(x, F.lit("?"), h), 256))


def siblings(path: Column) -> Column:
    """All siblings on a path, left to right and upwards."""
    return F.translate(path, " ?", "")


def _levels(con, rows: pa.Table, most: int) -> tuple[pa.ChunkedArray, pa.ChunkedArray]:
    """(inner path, block's root) of each row of ``rows`` (place, block, pos, steps, h), in order."""
    con.register("given", rows)
    con.execute("CREATE OR REPLACE TEMP TABLE nodes AS SELECT block, pos, steps, h FROM given")
    con.execute("CREATE OR REPLACE TEMP TABLE paths AS SELECT place, block, pos, steps, '' AS path FROM given")
    for level in range(most):
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE runs AS SELECT block, pos // {FAN} AS pos, any_value(steps) AS steps, "
            f"string_agg(h, '' ORDER BY pos) AS run FROM nodes WHERE steps > {level} GROUP BY block, pos // {FAN}"
        )
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE paths AS SELECT p.place, p.block, p.pos // {FAN} AS pos, p.steps, CASE WHEN r.run IS NULL THEN p.path "
            f"ELSE p.path || '{' ' if level else ''}' || left(r.run, {HEX} * (p.pos % {FAN})) || '?' || substr(r.run, {HEX} * (p.pos % {FAN} + 1) + 1) END AS path "
            f"FROM paths p LEFT JOIN runs r ON p.block = r.block AND p.pos // {FAN} = r.pos"
        )
        con.execute(
            f"CREATE OR REPLACE TEMP TABLE nodes AS SELECT block, pos, steps, sha256(run) AS h FROM runs "
            f"UNION ALL SELECT block, pos, steps, h FROM nodes WHERE steps <= {level}"
        )
    out = con.sql("SELECT path, n.h FROM paths JOIN nodes n USING (block) ORDER BY place").to_arrow_table()
    con.unregister("given")
    return out.column(0), out.column(1)


def _blocks(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Nodes (tree, pos, n, h) with ``path`` in their block and the block's ``top``; n is the number of nodes of the tree."""
    width = FAN**LEVELS
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join(f"{c} {kind}" for c, kind in ({"tree": "string", "pos": "long", "n": "long"} | kinds | {"path": "string", "top": "string"}).items())
    powers = FAN ** np.arange(LEVELS, dtype=np.int64)

    def edges(table: pa.Table) -> np.ndarray:
        """Whether each row begins a block; rows are sorted."""
        tree, pos = table.column("tree").combine_chunks(), table.column("pos").to_numpy() // width
        out = np.ones(table.num_rows, bool)
        out[1:] = (pos[1:] != pos[:-1]) | (tree.slice(1).to_numpy(zero_copy_only=False) != tree.slice(0, len(tree) - 1).to_numpy(zero_copy_only=False))
        return out

    def whole(con, table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = np.cumsum(edges(table)) - 1
        steps = np.minimum(np.searchsorted(powers, table.column("n").to_numpy(), "left"), LEVELS)
        rows = pa.table({"place": np.arange(table.num_rows), "block": block, "pos": table.column("pos").to_numpy() % width, "steps": steps, "h": table.column("h")})
        path, top = _levels(con, rows, int(steps.max()))
        yield from table.drop_columns(["h"]).append_column("path", path).append_column("top", top).to_batches(4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        held: pa.Table | None = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows >= BATCH:
                held = held.combine_chunks()
                last = int(np.flatnonzero(edges(held))[-1])
                if last:
                    yield from whole(con, held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield from whole(con, held.combine_chunks())
        con.close()

    dealt = nodes.select("tree", "pos", "n", *keep, "h").repartition(partitions(nodes.sparkSession), "tree", F.expr(f"pos div {width}"))
    return dealt.sortWithinPartitions("tree", "pos").mapInArrow(run, schema)


def climb(nodes: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of nodes (tree, pos, n, h), with tree, path to the root of its tree and that ``root``."""
    width = FAN**LEVELS
    inner = materialize(_blocks(nodes, keep), name)
    tops = inner.where(F.col("pos") % width == 0).select("tree", F.expr(f"pos div {width}").alias("pos"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.col("top").alias("h"))
    done = inner.where(F.col("n") <= width).select("tree", *keep, "path", F.col("top").alias("root"))
    if not tops.where("n > 1").limit(1).count():
        return done
    outer = climb(tops.where("n > 1").withColumn("block", F.col("pos")), ["block"], f"{name}-up")
    outer = outer.select("tree", F.col("block").alias("own_block"), F.col("path").alias("above"), "root")
    deep = inner.where(F.col("n") > width).withColumn("own_block", F.expr(f"pos div {width}")).join(outer, ["tree", "own_block"])
    return done.union(deep.select("tree", *keep, F.concat_ws(" ", "path", "above").alias("path"), "root"))


def manifest(docs: DataFrame, **also: Column) -> DataFrame:
    """(doc_id, source, leaf, path, subroot, root) of each row, and ``also``'s columns; ``path`` leads from the leaf to the root."""
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("tree"), leaf().alias("leaf"), *[v.alias(k) for k, v in also.items()])
    rows = numbered(materialize(rows, "leaves"), "number", "tree", "doc_id", "leaf")
    trees = rows.groupBy("tree").agg(F.min("number").alias("begin"), F.count(F.lit(1)).alias("n"))
    placed = rows.join(trees, "tree").withColumns({"pos": F.col("number") - F.col("begin"), "h": F.col("leaf")})
    inner = climb(placed, ["doc_id", "leaf", *also], "inner-paths").withColumnsRenamed({"root": "subroot", "path": "below"})

    tops = materialize(inner.groupBy("tree").agg(F.first("subroot").alias("h")), "subroots")
    n = tops.count()
    tops = numbered(tops, "pos", "tree").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "pos", F.lit(n).cast("long").alias("n"), "h")
    outer = climb(tops, ["of"], "outer-paths").select(F.col("of").alias("tree"), F.col("path").alias("above"), "root")
    source = F.when(F.col("tree") != "", F.expr("substr(tree, 2)")).alias("source")
    path = F.concat_ws(" ", F.when(F.col("below") != "", F.col("below")), F.when(F.col("above") != "", F.col("above")))
    return inner.join(outer, "tree").select("doc_id", source, "leaf", path.alias("path"), "subroot", "root", *also)


def report(docs: DataFrame) -> DataFrame:
    """Every document's proof, and whether it still holds after the line feeds of every second text have gone."""
    odd = F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0
    found = F.when(odd & F.contains("text", F.lit("\n")), leaf(text=F.translate("text", "\n", "")))
    since = len(FOLDERS)
    proofs = manifest(docs, found=found).withColumn("folded_root", fold(F.coalesce("found", "leaf"), F.col("path")))
    proofs = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root")
    return settle(proofs.withColumn("verified", F.col("folded_root") == F.col("root")), "proofs", since)


def _sql() -> str:
    """The same by recursive queries, level by level, with the CRC from its polynomial."""
    def digest(text: str) -> str:
        parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({x})::VARCHAR || ':' || {x}, '-')" for x in parts) + "))"

    return f"""WITH RECURSIVE crc(i, c) AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM range(256) t(i)),
table256 AS (SELECT list(c ORDER BY i) AS t FROM crc),
given AS (SELECT *, row_number() OVER () AS id, coalesce('s' || source, '') AS tree, {digest("text")} AS leaf, {digest("replace(text, chr(10), '')")} AS changed,
  (xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 2) = 0 AS odd
  FROM documents, table256),
leaves AS (SELECT id, doc_id, leaf, CASE WHEN odd AND text IS NOT NULL THEN changed ELSE leaf END AS found, tree,
  row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM given),
nodes(lvl, tree, pos, n, h) AS (
  SELECT 0, tree, pos, n, leaf FROM leaves
  UNION ALL SELECT lvl + 1, tree, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lvl, tree, pos // 3),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL SELECT lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 3),
runs AS (SELECT lvl, tree, pos // 3 AS up, string_agg(h, '' ORDER BY pos) AS run FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT lvl, pos // 3 AS up, string_agg(h, '' ORDER BY pos) AS run FROM tops WHERE n > 1 GROUP BY ALL),
inner_walk(id, lvl, tree, pos, proof, h) AS (
  SELECT id, 0, tree, pos, '', found FROM leaves
  UNION ALL SELECT id, w.lvl + 1, w.tree, w.pos // 3, proof || left(run, 64 * (w.pos % 3)) || substr(run, 64 * (w.pos % 3) + 65),
    sha256(left(run, 64 * (w.pos % 3)) || h || substr(run, 64 * (w.pos % 3) + 65)) FROM inner_walk w JOIN runs r ON r.lvl = w.lvl AND r.tree = w.tree AND r.up = w.pos // 3),
arrived AS (SELECT id, tree, arg_max(proof, lvl) AS proof, arg_max(h, lvl) AS h FROM inner_walk GROUP BY ALL),
outer_walk(id, lvl, pos, proof, h) AS (
  SELECT id, 0, s.pos, proof, a.h FROM arrived a JOIN subroots s USING (tree)
  UNION ALL SELECT id, w.lvl + 1, w.pos // 3, proof || left(run, 64 * (w.pos % 3)) || substr(run, 64 * (w.pos % 3) + 65),
    sha256(left(run, 64 * (w.pos % 3)) || h || substr(run, 64 * (w.pos % 3) + 65)) FROM outer_walk w JOIN top_runs r ON r.lvl = w.lvl AND r.up = w.pos // 3),
folded AS (SELECT id, arg_max(proof, lvl) AS proof, arg_max(h, lvl) AS folded_root FROM outer_walk GROUP BY id)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM leaves JOIN folded USING (id) JOIN subroots s USING (tree) JOIN (SELECT h FROM tops WHERE n = 1) t ON true"""


REPORT_SQL = _sql()
