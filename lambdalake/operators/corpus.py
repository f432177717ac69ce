"""Corpora of programs as DataFrames: evaluation on the test suite, quality, dedup, expansion, sampling.

A program row has program (text), type, size. Its fingerprint is the array of its values on the ten test
inputs, each as text, NULL for a failure; arrays are ordinary grouping and join keys. Text keeps types apart,
as ``true`` is not ``1``; ``untyped`` makes them one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dsl import interpreter, syntax, types
from ..dsl.compiler import column, compile_function
from ..dsl.primitives import SIGNATURES, get_grammar
from ..functions.digests import md5_of_pairs
from ..functions.order import numbered, running_total, spread

#: Test inputs, probe values and constants (fixed values).
TEST_SUITE = [[], [0], [3, 1, 2], [1, 1, 1, 1], [5, 4, 3, 2, 1], [1, 2, 3, 4, 5, 6, 7, 8], [10, -3, 7, 7, 0], [2, 8, 3, 8, 2, 3], [0, 1, 0, 1, 0], [42]]
PROBES = {"int": [0, 1, 3], "bool": [True, False], "list[int]": [[], [1], [2, 1, 3]], "list[bool]": [[], [True], [True, False]]}
HOLE_PROBES = [5, 3, 7, 2, 9, 0, 8, 1, 6, 4]
SEED_CONSTANTS = list(range(11))
MIN_SUCCESSES, MIN_VARIABILITY = 3, 0.3
#: A lexeme of a program's text.
LEXEME = r"(λ|[()\[\]]|\d+|[^\s()\[\]λ]+)"
#: Texts of programs whose values a task keeps at most.
REMEMBERED = 50_000
#: Places of a sketch that are expanded as one array.
BLOCK = 1 << 14


def value_text(value: object) -> str | None:
    return None if value is None or callable(value) else json.dumps(value, separators=(",", ":"))


def evaluate(programs: DataFrame, inputs: list[list[int]] | None = None) -> DataFrame:
    """With ``fp``: programs are data, so each batch is interpreted; a text that is no program has a NULL. Rows are dealt out
    first, and a task interprets a text that it has met before only once."""
    inputs = TEST_SUITE if inputs is None else inputs
    schema = programs.select("*", F.lit(None).cast("array<string>").alias("fp")).schema
    at = programs.columns.index("program")

    def values(text: str | None) -> list[str | None] | None:
        try:
            node = syntax.parse(text or "")
            node = syntax.fill(node if isinstance(node, syntax.Lam) else syntax.Lam(("x",), node), HOLE_PROBES)
            types.infer(node, SIGNATURES)
            return [value_text(v) for v in interpreter.outputs(node, inputs)]
        except (ValueError, RecursionError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str | None, list[str | None] | None] = {}
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text not in met:
                    if len(met) >= REMEMBERED:
                        met.clear()
                    met[text] = values(text)
                out.append(met[text])
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*batch.schema.names, "fp"])

    return spread(programs).mapInArrow(run, schema)


def fingerprint_columns(spark: SparkSession, programs: list[str]) -> DataFrame:
    """The same for a few programs, natively: each is one column over the table of test inputs."""
    tests = spark.createDataFrame(list(enumerate(TEST_SUITE)), "idx int, xs array<bigint>")
    out = []
    for p in programs:
        _, t = compile_function(p, [types.ListOf(types.INT)])
        value = F.to_json(column(p, "xs", types=[types.ListOf(types.INT)])) if isinstance(t.result, types.ListOf) else column(p, "xs", types=[types.ListOf(types.INT)]).cast("string")
        out.append(value.alias(p))
    wide = tests.select("idx", F.array(*out).alias("values"))
    rows = wide.select("idx", F.posexplode("values").alias("k", "v")).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("rows"))
    names = spark.createDataFrame(list(enumerate(programs)), "k int, program string")
    return names.join(rows, "k").select("program", F.transform("rows", lambda r: r["v"]).alias("fp"))


def untyped(fp: Column) -> Column:
    """Fingerprints in which true is 1 and false is 0."""
    return F.transform(fp, lambda v: F.regexp_replace(F.regexp_replace(v, "true", "1"), "false", "0"))


def successes(fp: Column) -> Column:
    return F.size(F.filter(fp, lambda v: v.isNotNull()))


def distinct_values(fp: Column) -> Column:
    return F.size(F.array_distinct(F.filter(fp, lambda v: v.isNotNull())))


def is_non_crashing(fp: Column, least: int = MIN_SUCCESSES) -> Column:
    return successes(fp) >= least


def is_non_constant(fp: Column) -> Column:
    return distinct_values(fp) >= 2


def variability(fp: Column) -> Column:
    """Share of distinct values among those that are no failures; 0 for one or none."""
    return F.when(successes(fp) <= 1, F.lit(0.0)).otherwise(distinct_values(fp) / successes(fp))


def good(fp: Column, least: int = MIN_SUCCESSES, spread: float = MIN_VARIABILITY) -> Column:
    return is_non_crashing(fp, least) & is_non_constant(fp) & (variability(fp) >= spread)


def dedup(programs: DataFrame, order: str, keys: tuple[str, ...] = ("type", "fp")) -> DataFrame:
    """The first row by ``order`` of each key, as one pre-aggregating minimum (no sort of any group)."""
    rest = [c for c in programs.columns if c not in keys]
    ahead = [order, *[c for c in rest if c != order]]
    best = programs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ahead)).alias("__first"))
    return best.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(programs.columns)


def novel(programs: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("fp",)) -> DataFrame:
    return programs.join(known.select(*keys).distinct(), list(keys), "left_anti")


def reward(fp: Column, is_known: Column) -> Column:
    """Variability, a tenth of it for known behaviour; 0 if it crashes or is constant."""
    return F.when(is_non_crashing(fp) & is_non_constant(fp), variability(fp) * F.when(is_known, 0.1).otherwise(1.0)).otherwise(0.0)


def with_reward(programs: DataFrame, known: DataFrame) -> DataFrame:
    seen = known.select("fp").distinct().withColumn("__known", F.lit(True))
    joined = programs.join(seen, "fp", "left")
    return joined.withColumn("reward", reward(F.col("fp"), F.coalesce("__known", F.lit(False)))).drop("__known")


def top_k(programs: DataFrame, k: int, order: str) -> DataFrame:
    """The ``k`` of highest reward, one for each behaviour; of equals the earlier one."""
    return dedup(programs, order, ("fp",)).orderBy(F.desc("reward"), order).limit(k)


def holes(program: Column) -> Column:
    return F.size(F.split(program, "int_hole", -1)) - 1


def fill(program: Column, values: Column) -> Column:
    """Holes replaced in the order of the text, which is the pre-order of the tree."""
    parts = F.split(program, "int_hole", -1)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(values, lambda v, i: F.concat(v.cast("string"), F.get(parts, i + 1))), ""))


def expand(sketches: DataFrame, constants: list[int] | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """Sketches with constants in their holes: all combinations, or, for who asks for no more than ``most``, as many draws where
    there are more. Each row has program, sketch, type, size, substitution and ``place``, its number among the sketch's. A sketch's
    places are dealt out in blocks, so neither memory nor the work of a task grows with the combinations."""
    constants = SEED_CONSTANTS if constants is None else constants
    n, k = len(constants), holes(F.col("program"))
    pool = F.array(*[F.lit(c) for c in constants])
    # As whole numbers, which doubles are not beyond 2 ** 53; more fillings than a long can count are no list to be made.
    powers = [n**i for i in range(64) if n**i < 1 << 63]
    power = lambda i: F.get(F.array(*[F.lit(p).cast("long") for p in powers]), i)
    combos = F.coalesce(power(k), F.when(k.isNotNull(), F.raise_error(F.lit("a sketch with more fillings than a long can count"))) if most is None else F.when(k.isNotNull(), F.lit((1 << 63) - 1)))
    many = combos if most is None else F.least(combos, F.lit(most).cast("long"))
    rows = sketches.withColumn("__k", k).withColumn("__n", many).withColumn("__all", F.lit(True) if most is None else combos <= most).where("__n > 0")
    rows = spread(rows.withColumn("__block", F.explode(F.expr(f"sequence(0L, (__n - 1) div {BLOCK}L)"))))
    rows = rows.withColumn("place", F.explode(F.expr(f"sequence(__block * {BLOCK}L, least(__block * {BLOCK}L + {BLOCK - 1}L, __n - 1))")))
    draw = lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "program", F.col("place").cast("string"), i.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(n))
    digit = lambda i: F.when(F.col("__all"), F.call_function("div", F.col("place"), power(F.col("__k") - 1 - i)) % n).otherwise(draw(i))
    indices = F.when(F.col("__k") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("__k") - 1, F.lit(0))), lambda i: F.get(pool, digit(i).cast("int")))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("substitution", indices)
    return rows.select(fill(F.col("program"), F.col("substitution")).alias("program"), F.col("program").alias("sketch"), *[c for c in sketches.columns if c != "program"], "substitution", "place")


def best_filling(filled: DataFrame) -> DataFrame:
    """Each sketch's substitution of the highest reward, the first of equals."""
    return filled.groupBy("sketch").agg(F.max_by(F.struct("program", "substitution", "reward"), F.struct("reward", -F.col("place"))).alias("best")).select("sketch", "best.*")


def until(programs: DataFrame, target: int, sketch_order: str, sketch: str = "sketch") -> DataFrame:
    """Whole sketches in order until ``target`` rows are reached (the sketch that reaches it is kept whole).
    Sizes per sketch are aggregated first; the running total is over these, by ranges."""
    sizes = programs.groupBy(sketch).agg(F.count(F.lit(1)).alias("n"), F.min(sketch_order).alias("o"))
    before = running_total(sizes, "__before", "n", "o", sketch)
    return programs.join(before.where(F.col("__before") < target).select(sketch), sketch, "left_semi")


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same ones on any cluster."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def measures(programs: DataFrame) -> DataFrame:
    """With size, depth, holes, free names and the canonical text of each program (NULL for no program)."""
    schema = programs.selectExpr("*", "cast(null as int) tree_size", "cast(null as int) depth", "cast(null as int) holes", "cast(null as array<string>) free", "cast(null as string) canonical").schema
    at = programs.columns.index("program")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(at).to_pylist():
                try:
                    n = syntax.parse(text or "")
                    rows.append((syntax.size(n), syntax.depth(n), syntax.holes(n), sorted(syntax.free(n) - set(SIGNATURES)), syntax.show(syntax.close(n))))
                except ValueError:
                    rows.append((None,) * 5)
            kinds = [pa.int32()] * 3 + [pa.list_(pa.string()), pa.string()]
            extra = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([*batch.columns, *extra], schema.names)

    return programs.mapInArrow(run, schema)


def depth(program: Column) -> Column:
    """Depth of a program's text, as ``syntax.depth``, by a scan of its brackets: names of functions and empty lists have none."""
    bare = F.regexp_replace(F.regexp_replace(program, r"\(λ\s*\([^()]*\)", "(λ"), r"\[\s*\]", "")
    marks = F.regexp_extract_all(F.translate(bare, "[]", "()"), F.lit(r"([()])"), 1)

    def step(at: Column, mark: Column) -> Column:
        now = at["now"] + F.when(mark == "(", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda at: at["most"])


def depth_distribution(programs: DataFrame, keys: list[str]) -> DataFrame:
    """How many programs of each group have which depth, and which share of the group; no program has no depth. Counts are
    aggregated before shares are taken."""
    counts = programs.where("program is not null").groupBy(*keys, depth(F.col("program")).alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    same = F.lit(True)
    totals = totals.toDF(*[f"__of_{c}" for c in keys], "__total")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return counts.join(totals, same).select(*keys, "depth", "n", (F.col("n") / F.col("__total")).alias("share"))


def validation_split(texts: DataFrame) -> DataFrame:
    """Distinct programs from int lists to int lists that succeed on some input."""
    rows = measures(evaluate(texts.select("program").distinct())).where(F.col("fp").isNotNull() & (successes(F.col("fp")) > 0))
    is_list = F.forall("fp", lambda v: v.isNull() | v.rlike(r"^\[(-?\d+(,-?\d+)*)?\]$"))
    return rows.where(is_list).select(F.col("canonical").alias("program"), F.lit("list[int]").alias("type"), F.col("tree_size").alias("size"), "fp")


def tokens(program: Column) -> Column:
    """Lexemes of a program's text."""
    return F.regexp_extract_all(program, F.lit(LEXEME), 1)


def vocabulary() -> list[str]:
    """Specials, brackets, keywords, primitives, 0 to 99, binders."""
    return ["<pad>", "<s>", "</s>", "<unk>", "(", ")", "[", "]", "λ", "true", "false", "if", *SIGNATURES, *map(str, range(100)), *[f"_p{i}" for i in range(26)]]


def token_ids(program: Column, words: list[str] | None = None) -> Column:
    """Ids of a program's lexemes, with start and end; strangers have the id of <unk>."""
    words = vocabulary() if words is None else words
    table = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(i))])
    ids = F.transform(tokens(program), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(words.index("<unk>"))))
    return F.concat(F.array(F.lit(words.index("<s>"))), ids, F.array(F.lit(words.index("</s>"))))


def shuffled(program: Column, names: dict[str, str]) -> Column:
    """The program under other names for primitives, with its preamble of the names used, sorted by new name."""
    table = F.create_map(*[x for a, b in names.items() for x in (F.lit(a), F.lit(b))])
    lexemes = tokens(program)
    text = F.array_join(F.transform(lexemes, lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")
    used = F.array_sort(F.array_distinct(F.transform(F.filter(lexemes, lambda t: F.map_contains_key(table, t)), lambda t: F.struct(F.try_element_at(table, t).alias("new"), t.alias("old")))))
    return F.struct(F.transform(used, lambda u: F.concat(u["new"], F.lit("="), u["old"])).alias("preamble"), text.alias("program"))


def _permutations(ids: pa.Array, names: list[str], k: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each row which names it permutes, and into which each of them goes (-1: into none): the first ``k`` by one hash of row
    and name, ordered by another. A row without an id permutes none."""

    def ranked(salt: str, among: np.ndarray) -> np.ndarray:
        heads = pc.binary_join_element_wise(f"{salt}:", pc.fill_null(ids, ""), ":", "").cast(pa.large_binary())
        _, offsets, data = heads.buffers()
        at = np.frombuffer(offsets, np.int64)[: len(heads) + 1]
        high, low = md5_of_pairs(np.frombuffer(data, np.uint8), at, [n.encode() for n in names], among).transpose(0, 2, 1)
        first = np.where(among, high, np.uint64(2**64 - 1))
        order = np.argsort(first, axis=1, kind="stable")
        ranks = np.take_along_axis(first, order, 1)
        # Halves that agree are as good as never met; such rows are sorted by whole hashes and names.
        for r in np.flatnonzero(((ranks[:, 1:] == ranks[:, :-1]) & (np.arange(1, len(names)) < among.sum(1)[:, None])).any(1)).tolist():
            order[r] = sorted(range(len(names)), key=lambda i: (not among[r, i], high[r, i], low[r, i], names[i]))
        return order

    own = np.repeat(np.asarray(ids.is_valid())[:, None], len(names), 1)
    if k is not None:
        own &= np.argsort(ranked("pick", own), axis=1) < k[:, None]
    row, name = np.nonzero(own)
    if len(row) == own.size:
        return own, ranked("to", own)
    counts = own.sum(1)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    into = np.full(own.shape, -1, np.int64)
    into[row, name] = ranked("to", own)[row, place]
    return own, into


def _lexemes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``tokens`` of a batch: how many each text has (none if NULL), and all of them as numbers of different ones, which follow.
    Marks are set apart and the rest is split at spaces; a number that runs into a name is left to the regular expression."""
    apart = texts
    for mark in "()[]λ":
        apart = pc.replace_substring(apart, mark, f" {mark} ")
    apart = pc.ascii_trim_whitespace(apart)
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(apart, ""), pa.scalar(None, pa.string()), apart))
    words = lists.flatten().dictionary_encode()
    if any(w[0] in "0123456789" and w.strip("0123456789") for w in words.dictionary.to_pylist()):
        lists = pa.array([re.findall(LEXEME, t or "", re.ASCII) for t in texts.to_pylist()], pa.list_(pa.string()))
        words = lists.flatten().dictionary_encode()
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), words.indices.to_numpy(), words.dictionary


def renamed(rows: DataFrame, row: Column, program: Column, names: list[str], k: Column | None = None) -> DataFrame:
    """The rows' programs under names of their own, as ``shuffled``: each row, which ``row`` identifies as a text, has a permutation
    of all names, or of ``k`` that it picks (at least none, at most all). With ``program``, ``preamble`` and ``bijection``, whether
    the row's names go into just these names. Names are few; each batch is hashed, sorted and renamed as arrays, and its texts
    are split by Arrow, as ``tokens`` took most of the time."""
    shown = rows.columns
    few = F.lit(len(names)) if k is None else F.least(F.greatest(k, F.lit(0)), F.lit(len(names)))
    given = rows.select("*", row.alias("__row"), program.alias("__text"), few.cast("int").alias("__k"))
    schema = rows.select("*", F.lit(None).cast("string").alias("program"), F.lit(None).cast("array<string>").alias("preamble"), F.lit(True).alias("bijection")).schema
    n, some = len(names), k is not None
    by_text = sorted(range(n), key=lambda i: names[i].encode())
    known, in_order = pa.array(names, pa.string()), pa.array([f"{names[a]}={names[b]}" for a in by_text for b in range(n)], pa.string())
    rank = np.argsort(by_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts, most = batch.columns[-3:]
            own, into = _permutations(ids, names, most.to_numpy(zero_copy_only=False) if some else None)
            same = np.sort(np.where(own, into, n), 1) == np.sort(np.where(own, np.arange(n), n), 1)
            lengths, words, different = _lexemes(texts)
            at = np.repeat(np.arange(len(lengths)), lengths)
            old = pc.fill_null(pc.index_in(different, known), -1).to_numpy(zero_copy_only=False)[words]
            new = np.where(old >= 0, into[at, old], -1)
            text = pa.concat_arrays([known, different]).take(pa.array(np.where(new >= 0, new, n + words)))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), text), " ")
            hit = new >= 0
            used = np.unique((at[hit] * n + rank[new[hit]]) * n + old[hit])
            ends = pa.array(np.searchsorted(used, np.arange(len(lengths) + 1) * n * n), pa.int32())
            preamble = pa.ListArray.from_arrays(ends, in_order.take(pa.array(used % (n * n))))
            out = [pc.if_else(texts.is_valid(), x, pa.scalar(None, x.type)) for x in (joined, preamble)]
            yield pa.record_batch([*batch.columns[:-3], *out, pa.array(same.all(1) & np.asarray(ids.is_valid()))], [*shown, "program", "preamble", "bijection"])

    return given.mapInArrow(run, schema)


def io_views(pools: DataFrame, least: int, most: int) -> DataFrame:
    """One row for each number of shown pairs, with the first so many of the pool."""
    top = F.least(F.lit(most), F.size("pool"))
    return pools.where(top >= least).withColumn("shown", F.explode(F.sequence(F.lit(least), top))).withColumn("pairs", F.expr("slice(pool, 1, shown)"))


def redirect_empty(rows: DataFrame, order: str, group: list[str]) -> DataFrame:
    """Each row's pool, or that of the next row that has one, round the end of the group. Rows are placed in one order and looked
    ahead in blocks of it; the first pool of each block is handed to the blocks before, so no task has all rows of a group. Windows
    run from the end, as Spark starts a frame that ends with its partition anew for each row."""
    placed = numbered(rows, "__place", *group, order)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.withColumn("__block", (F.col("__place") / (placed.count() // (4 * parts) + 1)).cast("long"))
    some = F.when(F.size("pool") > 0, F.col("pool"))
    near = F.last(some, ignorenulls=True).over(Window.partitionBy("__block", *group).orderBy(F.desc("__place")).rowsBetween(Window.unboundedPreceding, 0))
    # A row for each block and group that it touches: as many as blocks and groups.
    blocks = placed.groupBy("__block", *group).agg(F.min_by(some, F.when(some.isNotNull(), F.col("__place"))).alias("__first"))
    w = Window.partitionBy(*group).orderBy(F.desc("__block"))
    later = F.last("__first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    around = F.last("__first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = blocks.select("__block", *group, F.coalesce(later, around).alias("__far"))
    blocks = blocks.toDF("__of_block", *[f"__of_{c}" for c in group], "__far")
    same = F.col("__block") == F.col("__of_block")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return placed.withColumn("__near", near).join(blocks, same, "left").select(*rows.columns, F.coalesce("__near", "__far").alias("served"))


def stratified(rows: DataFrame, keys: list[str], length: str, order: list[Column], n: int) -> DataFrame:
    """``n`` rows of each length quartile of a group."""
    quarter = F.ntile(4).over(Window.partitionBy(*keys).orderBy(length, *order))
    with_quarter = rows.withColumn("quartile", quarter)
    return with_quarter.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "quartile").orderBy(*order))).where(F.col("rank") <= n)


def io_samples(programs: DataFrame, candidates: int = 100, pool: int = 11, longest: int = 15, top: int = 100, seed: int = 0) -> DataFrame:
    """(program, pos, inp, out): random inputs with valid outputs modulo 100, ``pool`` of each program, spread
    over length quartiles, those not yet seen and no identities first."""
    import random

    schema = "program string, candidate int, inp array<long>, out array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0).to_pylist():
                rng = random.Random(f"{seed} {text}")
                inputs = [[rng.randint(0, top) for _ in range(rng.randint(0, longest))] for _ in range(candidates)]
                for i, (x, y) in enumerate(zip(inputs, interpreter.outputs(text, inputs), strict=True)):
                    if isinstance(y, list) and len(y) <= longest and all(type(v) in (int, bool) for v in y):
                        rows.append((text, i, x, [int(v) % 100 for v in y]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["program", "candidate", "inp", "out"])

    rows = programs.select("program").mapInArrow(run, schema)
    # Of candidates with one output the first is new, the others seen.
    seen = F.row_number().over(Window.partitionBy("program", "out").orderBy("candidate")) > 1
    rows = rows.withColumn("__seen", seen).withColumn("__same", F.col("inp") == F.col("out")).withColumn("__length", F.size("inp"))
    spread = stratified(rows, ["program"], "__length", [F.col("__seen"), F.col("__same"), F.col("candidate")], -(-pool // 4))
    pos = F.row_number().over(Window.partitionBy("program").orderBy("rank", "quartile"))
    return spread.withColumn("pos", pos).where(F.col("pos") <= pool).select("program", "pos", "inp", "out")


def check(pairs: DataFrame) -> DataFrame:
    """Whether a program gives all its pairs' outputs, modulo 100."""
    at = [pairs.columns.index(c) for c in ("program", "inp", "out")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            programs, inputs, outputs = (batch.column(i).to_pylist() for i in at)
            right = []
            for p, x, y in zip(programs, inputs, outputs, strict=True):
                got = interpreter.outputs(p, [x])[0]
                right.append(isinstance(got, list) and all(isinstance(v, int) for v in got) and [int(v) % 100 for v in got] == y)
            yield pa.record_batch([batch.column(at[0]), pa.array(right, pa.bool_())], ["program", "right"])

    return pairs.mapInArrow(run, "program string, right boolean").groupBy("program").agg(F.bool_and("right").alias("right"), F.count(F.lit(1)).alias("pairs"))


def io_score(pairs: DataFrame) -> DataFrame:
    """A quarter each of: variance of output lengths, variance of output elements, distinct outputs, no identities."""
    cells = pairs.select("program", F.size("out").alias("l"), "inp", "out")
    elements = pairs.select("program", F.explode("out").alias("e")).groupBy("program").agg(F.coalesce(F.var_samp("e"), F.lit(0.0)).alias("ve"))
    per = cells.groupBy("program").agg(
        F.coalesce(F.var_samp("l"), F.lit(0.0)).alias("vl"), (F.countDistinct("out") / F.count(F.lit(1))).alias("unique"), F.avg((F.col("inp") != F.col("out")).cast("int")).alias("changed")
    )
    score = 0.25 * (F.least(F.col("vl") / 10, F.lit(1.0)) + F.least(F.coalesce("ve", F.lit(0.0)) / 1000, F.lit(1.0)) + F.col("unique") + F.col("changed"))
    return per.join(elements, "program", "left").select("program", score.alias("score"))


def survival(results: DataFrame) -> DataFrame:
    """On how many grammars each program passes."""
    return results.groupBy("program").agg(F.sum(F.col("passed").cast("int")).alias("passes"), F.count(F.lit(1)).alias("grammars"))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    return rows.select(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def quartile_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, quartiles and greatest, where a quartile is the element at n // 4 of the sorted values (no interpolation).
    Rows are numbered in one order of keys and values, so that a key's rows are sorted by many tasks."""
    placed = numbered(rows.where(F.col(value).isNotNull()).select(*keys, value), "__i", *keys, value)
    ends = placed.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__n"))
    wanted = ends.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("__first") + F.floor(F.col("__n") * k / 4)).alias("__i")) for k in (1, 2, 3)])).alias("w")).select(*keys, "w.k", "w.__i")
    found = placed.select("__i", value).join(wanted, "__i").groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col(value))).alias(f"q{k}") for k in (1, 2, 3)])
    return ends.join(found, keys).select(*keys, "least", "q1", "q2", "q3", "most", "mean")


def constants_used(programs: DataFrame) -> DataFrame:
    """The different integers in a set of programs."""
    return programs.select(F.explode(tokens(F.col("program"))).alias("t")).where(F.col("t").rlike(r"^\d+$")).select(F.col("t").cast("long").alias("constant")).distinct()


def transitions(programs: DataFrame) -> DataFrame:
    """(program, step, state, action): the choices of the grammar that build a program top-down; a state is
    the type that is wanted and the names in scope."""
    schema = "program string, step int, state string, action string"
    at = programs.columns.index("program")

    def steps(text: str) -> list[tuple[str, str]]:
        node = types.copy(syntax.parse(text))
        run = types.Inference(SIGNATURES)
        run.infer(node, {})
        out: list[tuple[str, str]] = []

        def go(n: syntax.Node, scope: tuple[str, ...]) -> None:
            state = f"{types.show(run.resolve(run.of[id(n)], types.INT))} | {' '.join(scope)}"
            match n:
                case syntax.App(f, args):
                    out.append((state, f"apply {f}"))
                    for a in args:
                        go(a, scope)
                case syntax.Lam(params, body):
                    out.append((state, "lambda"))
                    go(body, (*scope, *params))
                case syntax.If():
                    out.append((state, "if"))
                    for c in syntax.children(n):
                        go(c, scope)
                case _:
                    out.append((state, str(n)))

        go(node, ())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                try:
                    rows += [(text, i, s, a) for i, (s, a) in enumerate(steps(text))]
                except ValueError:
                    continue
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.string(), pa.string()], strict=True)], ["program", "step", "state", "action"])

    return programs.mapInArrow(run, schema)


def count_policy(steps: DataFrame) -> DataFrame:
    """p(action | state), with the shares of coarser states to fall back to: the wanted type, then none."""
    kind = F.substring_index("state", " | ", 1)
    tier = lambda i, s: F.struct(F.lit(i).alias("tier"), s.alias("s"))
    tiers = steps.select("action", F.explode(F.array(tier(0, F.col("state")), tier(1, kind), tier(2, F.lit("")))).alias("t"))
    counted = tiers.groupBy("t.tier", F.col("t.s").alias("state"), "action").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("tier", "state").agg(F.sum("n").alias("all"))
    return counted.join(total, ["tier", "state"]).select("tier", "state", "action", "n", (F.col("n") / F.col("all")).alias("p"))


def valid_actions(wanted: str, scope: dict[str, str], depth: int, nesting: int = 0, grammar: str = "default") -> list[str]:
    """The choices that fit a wanted type: names in scope, literals, branches and primitives (higher-order
    ones up to two functions deep)."""
    g, want, out = get_grammar(grammar), types.read(wanted), []
    out += [n for n, t in scope.items() if types.show(types.read(t)) == types.show(want)]
    out += {"int": ["int_hole"], "bool": ["true", "false"]}.get(types.show(want), ["[]"])
    if depth <= 0:
        return out
    out.append("if")
    for name, signature in g.signatures.items():
        if "(" in signature and nesting > 2:
            continue
        run = types.Inference({name: signature})
        t = run.signature(name)
        while isinstance(run.find(t), types.Fn):
            t = run.find(t).result
        try:
            run.unify(t, want)
        except ValueError:
            continue
        out.append(name)
    return out


def rollouts(spark: SparkSession, n: int, depth: int = 4, seed: int = 0, wanted: str = "list[int]", grammar: str = "default") -> DataFrame:
    """``n`` random programs from the grammar, top-down, one for each seed; all are well typed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([syntax.show(syntax.canonical(random_program(seed * 1_000_003 + i, wanted, depth, grammar))) for i in ids], pa.string())], ["episode", "program"])

    return spark.range(n).withColumnRenamed("id", "episode").mapInArrow(run, "episode long, program string")


def random_program(seed: int, wanted: str, depth: int, grammar: str = "default") -> syntax.Node:
    import random

    rng, signatures = random.Random(seed), get_grammar(grammar).signatures
    count = 0

    def make(want: types.Type, scope: dict[str, str], left: int, nesting: int) -> syntax.Node:
        nonlocal count
        if isinstance(want, types.Fn):
            params, own = [], dict(scope)
            while isinstance(want, types.Fn):
                params.append(f"v{count}")
                own[params[-1]] = types.show(want.argument)
                count, want = count + 1, want.result
            return syntax.Lam(tuple(params), make(want, own, left - 1, nesting + 1))
        action = rng.choice(valid_actions(types.show(want), scope, left, nesting, grammar))
        if action == "if":
            return syntax.If(make(types.BOOL, scope, left - 1, nesting), make(want, scope, left - 1, nesting), make(want, scope, left - 1, nesting))
        if action in scope:
            return syntax.Var(action)
        if action == "int_hole":
            return syntax.Num(rng.choice(SEED_CONSTANTS))
        if action in ("true", "false", "[]"):
            return syntax.parse(action)
        fits = []
        for pick in types.instantiations(signatures[action]):
            names: dict[str, types.Type] = dict(pick)
            t, arguments = types.read(signatures[action], names), []
            while isinstance(t, types.Fn):
                arguments.append(t.argument)
                t = t.result
            if types.show(t) == types.show(want):
                fits.append(arguments)
        if not fits:
            return make(want, scope, 0, nesting)
        return syntax.App(syntax.Var(action), tuple(make(a, scope, left - 1, nesting) for a in rng.choice(fits)))

    return syntax.Lam(("x",), make(types.read(wanted), {"x": "list[int]"}, depth, 1))
