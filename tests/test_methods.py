"""The method contract, registries, the run log source, and literals of responses."""

import ast
import json

import pytest
from pyspark.sql import functions as F

from lambdalake.functions import parsing
from lambdalake.operators import corpus
from lambdalake.functions.order import running_total
from lambdalake.sources import files, methods

CELLS = [
    "[1, 2]", "(1, 2)", "1, 2", "1,", "(1,)", "(1)", "()", "[]", "[ ]", "[1, 2,]", "[,]", "[1.5]", "[-1.9, 2e1, .5]", "[True, False]", "True", "1.5", "-3", "+4", "[+4]", "[-0]", "007", "[007]", "1_000", "['3']",
    '["-4 "]', "['a']", "[[1]]", "[None]", "{1}", "[1 2]", "abc", "C([1, 2])", "C([])", "C(3)", "[1,\n 2]", "(True, 2)", "[9007199254740993]", "[1e400]", "", "NA", "(", "[1", "(1.5)", "(1.5,)",
]


def literal(text):
    """How the cells are to be read, by Python's own literals."""
    text = text.strip()
    if text in parsing.MISSING:
        return None
    if text.startswith("C([") and text.endswith("])"):
        text = text[2:-1]
    try:
        v = ast.literal_eval(text)
        return [int(x) for x in v] if isinstance(v, (list, tuple)) else [int(v)] if isinstance(v, int) else None
    except (ValueError, SyntaxError, TypeError, OverflowError):
        return None


def test_response_literals(spark):
    rows = spark.createDataFrame(list(enumerate(CELLS)), "i int, c string").select("i", parsing.response(F.col("c")).alias("r")).collect()
    for r in rows:
        want = literal(CELLS[r.i])
        assert (r.r.value if want is None else list(r.r.value or [])) == want, CELLS[r.i]
        assert r.r.kind == ("NO_RESPONSE" if want is None else "LIST" if want else "EMPTY")


def test_names(spark):
    got = spark.createDataFrame([("tx_enum_iw_enc_L2",), ("tx_enrl_es_dec_post",), ("mpl",), ("tx_a_enc_L",)], "n string").select(parsing.method_layer(F.col("n")).alias("l")).collect()
    assert [r.l and tuple(r.l) for r in got] == [("enum_iw", "enc", 2), ("enrl_es", "dec", -1), None, None]
    one = spark.createDataFrame([("MemorizeAll.Sample2Rule.(x).Atom(Some(a.b)).[.q",)], "t string").select(parsing.part_names(F.col("t")).alias("n")).first()
    assert one.n == ["MemorizeAll", "Sample", "Atom", "q"]


def test_cells_with_line_feeds(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,order,trial,response,program,accuracy,cpu,run\na,1,1,"[1,\n2]","(λ (x)\n x)",True,2,1\na,1,1,[3],p,0,,2\na,1,1,[3],p,1,4,2\nb,1,2,NA,q,False,x,1\n')
    method = files.METHODS.make("codex", spark=spark, path=f"{tmp_path}/m.csv", label="Codex")
    trials = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 1)], "id string, order int, trial int")
    got = {r.id: r for r in method.predict(trials).collect()}
    assert got["a"].response.value == [3] and got["a"].program == "p" and got["a"].correct and got["a"].mean_correct == pytest.approx(2 / 3) and got["a"].cpu == 3
    assert got["b"].response.kind == "NO_RESPONSE" and not got["b"].correct and got["b"].cpu == 0 and got["c"].response is None and got["c"].correct is False
    runs = {(r.id, r.run): (list(r.response.value or []), r.correct) for r in method.per_run(trials).collect()}
    assert runs == {("a", "1"): ([1, 2], True), ("a", "2"): ([3], True), ("b", "1"): ([], False)}
    with pytest.raises(methods.MissingCapability):
        method.embed(trials)
    vectors = spark.createDataFrame([("a", 1, 1, [1.0])], "id string, order int, trial int, embedding array<double>")
    plugged = files.METHODS.make("table", rows=method.rows, vectors=vectors, efforts=("cpu",))
    assert [r.embedding for r in plugged.embed(trials).collect()] == [[1.0]]
    with pytest.raises(ValueError):
        files.METHODS.make("none")
    assert set(files.ANALYSES.entries) == {"rule_acquisition", "failure_modes", "clustering", "error_similarity", "probing"}


def test_run_log(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / f"{run}.jsonl").write_text("".join(json.dumps({"step": i, "key": "loss", "value": i / 2, "more": "x"}) + "\n" for i in range(5)))
    (tmp_path / "run=c").mkdir()
    (tmp_path / "run=c" / "part-0.json").write_text('{"step": 1, "key": "loss", "value": 3}\n')
    (tmp_path / "run=c" / "empty.json").write_text("")
    methods.RunLog.register(spark)
    log = spark.read.format("run_log").load(str(tmp_path))
    assert log.count() == 11 and log.rdd.getNumPartitions() == 4
    one = log.where("run = 'b' and value > 1")
    assert one.rdd.getNumPartitions() == 1 and sorted(r.step for r in one.collect()) == [3, 4]
    assert [tuple(r) for r in log.where("run = 'c'").collect()] == [("c", 1, "loss", 3.0)]


def test_running_total_and_until(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(100)], "i long, v long")
    got = {r.i: r.before for r in running_total(rows, "before", "v", "i").collect()}
    assert got == {i: sum(k % 7 for k in range(i)) for i in range(100)}
    programs = spark.createDataFrame([(f"s{i // 3:02}", i) for i in range(60)], "sketch string, place long")
    for target in (1, 3, 4, 30, 1000):
        kept = {r.sketch for r in corpus.until(programs, target, "place").collect()}
        assert kept == {f"s{k:02}" for k in range(min(20, -(-target // 3)))}


def test_redirects_without_a_window_over_a_group(spark):
    import random

    rng = random.Random(3)
    data = [(i, rng.randrange(3), [i] if rng.random() < 0.2 else []) for i in range(300)] + [(1000 + i, 9, []) for i in range(3)]
    rows = spark.createDataFrame(data, "i long, g int, pool array<long>")
    got = {r.i: r.served for r in corpus.redirect_empty(rows, "i", ["g"]).collect()}
    for i, g, _ in data:
        same = [(j, p) for j, h, p in data if h == g]
        ring = [p for j, p in same if j >= i] + [p for j, p in same if j < i]
        assert got[i] == next((p for p in ring if p), None)
