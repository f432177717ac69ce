"""Sources, parsing, statistics, trials and corpora on hand-made rows."""

import collections
import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lambdalake.dsl import syntax
from lambdalake.functions import learning, parsing, stats
from lambdalake.operators import corpus, trials
from lambdalake.plans import enumeration
from lambdalake.sources import files
from lambdalake.streaming import trials as streams


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def test_responses(spark):
    cells = ["NA", "", None, "[]", "[1, 2]", "C([1,2])", "7", "garbage", '[1, "a"]', "-3", "[ ]", "[1,-2]"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", parsing.response(F.col("c")).alias("r")).orderBy("i").collect()
    kinds = [r.r.kind for r in rows]
    assert kinds == ["NO_RESPONSE"] * 3 + ["EMPTY"] + ["LIST"] * 3 + ["NO_RESPONSE"] * 2 + ["LIST", "EMPTY", "LIST"]
    assert rows[4].r.value == [1, 2] and rows[5].r.value == [1, 2] and rows[6].r.value == [7] and rows[9].r.value == [-3] and rows[7].r.value is None


def test_cells(spark):
    df = spark.createDataFrame([("TRUE", "y", "1.5"), ("0.25", "n", "x"), (None, "NA", None)], "a string, b string, c string")
    got = df.select(parsing.truthy(F.col("a")).alias("a"), parsing.feature(F.col("b")).alias("b"), parsing.number(F.col("c")).alias("c"), parsing.log_posterior(F.col("c")).alias("l")).collect()
    assert [tuple(r) for r in got] == [(1.0, True, 1.5, 1.5), (0.25, False, 0.0, float("-inf")), (0.0, None, 0.0, float("-inf"))]
    assert parsing.boolean_columns(df) == ["b"]
    parts = spark.createDataFrame([("Map(a.b).Take 3.Drop[.]",)], "t string").select(parsing.metaprogram_parts(F.col("t")).alias("p"), parsing.part_names(F.col("t")).alias("n"), parsing.method_layer(F.lit("tx_m_enc_L2")).alias("l")).first()
    assert parts.p == ["Map(a.b)", "Take 3", "Drop[", "]"] and parts.n == ["Map", "Take", "Drop"] and tuple(parts.l) == ("m", "enc", 2)


def test_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,program,gloss,odd,rank\nc001,p,\"a, b\",TRUE,1\nc002,q,g,NA,2\nz9,r,g,false,x\n")
    (tmp_path / "s.csv").write_text("id,order,trial,input,output\n" + "".join(f"c001,1,{t},\"[{t}, 2]\",\"[{t}]\"\n" for t in (1, 2, 3)) + "z9,1,1,[],[]\n")
    functions, stimuli = files.functions(spark, f"{tmp_path}/f.csv"), files.stimuli(spark, f"{tmp_path}/s.csv")
    assert values(functions.orderBy("id"), "id", "odd") == [("c001", True), ("c002", None), ("z9", False)] and dict(functions.dtypes)["rank"] == "string"
    tasks = files.tasks(functions, stimuli).orderBy("trial").collect()
    assert [(r.id, r.trial, len(r.observed)) for r in tasks] == [("c001", 1, 0), ("c001", 2, 1), ("c001", 3, 2)]
    with pytest.raises(ValueError):
        files.table(spark, f"{tmp_path}/f.csv", {"id": "none"})
    (tmp_path / "p.csv").write_text("id,order,trial,response,accuracy,cpu\nc001,1,1,[1],True,2.5\nc001,1,2,NA,False,\n")
    joined = files.join_predictions(files.tasks(functions, stimuli), files.predictions(spark, f"{tmp_path}/p.csv", "metagol")).orderBy("trial").collect()
    assert [(r.accuracy, r.cpu) for r in joined] == [(1.0, 2.5), (0.0, 0.0), (0.0, None)]
    programs = spark.createDataFrame([("(λ (x) x)", "list[int]", 2)] * 5, files.CORPUS)
    files.write_corpus(programs, f"{tmp_path}/corpus", 2)
    (tmp_path / "c.json").write_text(json.dumps([{"program": "(λ (x) x)", "type": "list[int]", "size": 2}]))
    assert spark.read.json(f"{tmp_path}/corpus").count() == 5 and files.corpora(spark, [f"{tmp_path}/c.json"] * 2).count() == 2
    assert values(files.manifest(programs), "n") == [5]
    (tmp_path / "t.txt").write_text("(λ (x) x)\n\n(λ (x) x)\n")
    assert files.program_lines(spark, f"{tmp_path}/t.txt").count() == 1
    files.write_table(programs, f"{tmp_path}/out.csv", "csv")
    assert files.table(spark, f"{tmp_path}/out.csv").count() == 5
    with pytest.raises(ValueError):
        files.config('{"methods": [{}]}')


def test_cache(spark, tmp_path):
    cache, made = files.Cache(spark, str(tmp_path)), []

    def make(rows):
        made.append(rows.count())
        return rows.withColumn("y", F.col("k") * 2)

    wanted = spark.range(3).withColumnRenamed("id", "k")
    assert cache.fill("p", {"a": 1}, wanted, ["k"], make).count() == 3
    assert cache.fill("p", {"a": 1}, spark.range(5).withColumnRenamed("id", "k"), ["k"], make).count() == 5 and made == [3, 2]
    assert cache.path("p", {"a": 1}) != cache.path("p", {"a": 2})
    cache.get("q", {}, lambda: wanted)
    assert cache.get("q", {}, lambda: 1 / 0).count() == 3
    registry = files.Registry()
    registry.register("m")(lambda x=1: x)
    assert registry.make("m", x=4) == 4
    with pytest.raises(ValueError):
        registry.make("n")


def trial_rows(spark, *sequences):
    return spark.createDataFrame([(f"f{i}", t + 1, c) for i, s in enumerate(sequences) for t, c in enumerate(s)], "function string, trial int, correct int")


def test_acquisition(spark):
    rows = trial_rows(spark, [1] * 11, [0] * 11, [0] * 10 + [1], [1, 0, 1], [1, 1, 0])
    got = dict(values(trials.acquisition(rows, ["function"]), "function", "acquired_on"))
    assert got == {"f0": 1, "f1": 12, "f2": 11, "f3": 3, "f4": 12}
    assert trials.complete(rows, ["function"]).select("function").distinct().count() == 3


def test_exclusion_without_time(spark):
    rows = spark.createDataFrame([("a", str(i), 1) for i in range(30)] + [("b", str(i), 1) for i in range(30)], "subject string, response string, correct int")
    time = spark.createDataFrame([("a", "5000")], "subject string, total_time_s string")
    assert values(trials.excluded_subjects(rows, time), "subject") == ["b"] and trials.excluded_subjects(rows, None).count() == 2


def test_modal_first_seen(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "cell int, response string, pos int")
    assert values(trials.modal_response(rows, ["cell"], "pos"), "modal", "n") == [("b", 2)]


def test_statistics(spark):
    assert stats.signed_rank_p(np.array([1, 2, 3, 4, 5.0])) == pytest.approx(0.0625) and stats.signed_rank_p(np.array([0, 0.0])) == 1.0
    counts = spark.createDataFrame([(10, 20, 30, 40), (5, 0, 5, 0)], "n11 int, n10 int, n01 int, n00 int")
    p = values(stats.chi2_p(counts), "p")
    assert p[0] == pytest.approx(0.5 * 0 + 0.3729, abs=1e-3) and p[1] == 1.0
    rows = spark.createDataFrame([(1, 0.9, 0.8), (1, 0.8, 0.3), (0, 0.7, 0.6), (0, 0.1, 0.4), (1, 0.6, 0.9)], "y int, a double, b double")
    d = stats.delong(rows, "y", "a", "b").first()
    assert d.auroc_a == pytest.approx(5 / 6) and d.auroc_b == pytest.approx(4 / 6) and 0 <= d.p <= 1
    assert stats.delong(rows.where("y = 1"), "y", "a", "b").first().p is None
    boot = stats.bootstrap(rows.withColumn("k", F.lit("x")), ["k"], "a", draws=200).first()
    assert boot.lo <= boot.estimate <= boot.hi
    means = values(stats.poisson_bootstrap(rows.withColumn("k", F.lit("x")), ["k"], "a", draws=100), "mean")
    assert 0.4 < np.nanmean([m for m in means if m is not None]) < 0.8
    same = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert tuple(stats.agreement(same, "a", "b").first()) == (pytest.approx(1.0), pytest.approx(1.0))
    z = values(stats.standardise(rows, ["a"]), "a")
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)


def test_corpus_steps(spark):
    sketches = spark.createDataFrame([("(λ (x) (slice int_hole int_hole x))", "list[int]", 5), ("(λ (x) x)", "list[int]", 2)], "program string, type string, size int")
    all_rows = corpus.expand(sketches, [0, 1, 2])
    assert all_rows.count() == 10 and all_rows.where("program = '(λ (x) (slice 0 2 x))'").count() == 1
    assert corpus.expand(sketches, [0, 1, 2], most=4).count() == 5
    evaluated = corpus.evaluate(all_rows)
    kept = corpus.dedup(evaluated.where(corpus.good(F.col("fp"))), "place", ("type", "fp"))
    assert kept.count() == kept.select("fp").distinct().count() and corpus.novel(kept, kept).count() == 0
    scored = corpus.with_reward(kept, kept.limit(0))
    assert corpus.best_filling(scored).count() == 2 and corpus.top_k(scored, 1, "place").count() == 1
    native = {r.program: r.fp for r in corpus.fingerprint_columns(spark, ["(λ (x) (reverse x))", "(λ (x) (/ 6 (first x)))"]).collect()}
    plain = {r.program: r.fp for r in corpus.evaluate(spark.createDataFrame([(p,) for p in native], "program string")).collect()}
    assert native == plain
    bad = corpus.evaluate(spark.createDataFrame([("(",), (None,), ("(λ (x) (+ x 1))",)], "program string"))
    assert values(bad, "fp") == [None, None, [None] * 10]
    assert corpus.until(all_rows.withColumn("o", F.length("sketch")), 1, "o").select("sketch").distinct().count() == 1
    assert spark.createDataFrame([(["true", "[false]", "1"],)], "fp array<string>").select(corpus.untyped(F.col("fp"))).first()[0] == ["1", "[0]", "1"]


def test_enumeration_matches_evaluation(spark):
    bank = enumeration.enumerate_programs(spark, 3, only=["+", "take", "reverse", "length", "map"])
    rows = enumeration.corpus(bank).withColumnRenamed("fp", "own")
    assert enumeration.compositions(4, 2) == [(1, 3), (2, 2), (3, 1)]
    got = corpus.evaluate(rows)
    assert got.where("own != fp").count() == 0 and got.where("type = 'int' and size = 3").count() >= 1
    assert got.groupBy("type", "own").count().where("count > 1 and own is not null").where("type = 'list[int]'").count() == 0


def test_learning(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) + 5 * (i % 2)).tolist(), i % 2, i % 2 == 0) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int, f boolean")
    clustered, k, score = learning.cluster(df, "v", [2, 3])
    assert k == 2 and score > 0.5 and learning.enrichment(clustered, ["f"]).where("enrichment > 0.5").count() == 1
    assert len(learning.project(df, "v").columns) == 6
    assert min(values(learning.probe(df, "v", "y", "id"), "auroc")) > 0.95
    assert learning.soft_rows(df.withColumn("s", F.lit(1.0)), "s").count() == 80
    assert min(values(learning.probe(df.withColumn("s", F.lit(0.1) + F.col("y") * 0.8), "v", "y", "id", share="s"), "auroc")) > 0.95
    null = learning.probe_null(df, "v", "y", "id", 2, n=2).collect()
    assert len(null) == 4 and max(r.auroc for r in null) < 0.95
    given = spark.createDataFrame([(i, i % 2, float(i if i % 3 else -i), i % 3 > 0) for i in range(30)], "id int, y int, s double, f boolean").withColumn("g", F.lit(1))
    assert {r.f for r in learning.conditional_auroc(given, "f", "y", "s", ["g"]).collect()} == {True, False}


def test_numbered(spark):
    from lambdalake.functions.order import numbered

    rows = spark.range(1000).select((F.xxhash64("id") % 50).alias("a"), "id")
    got = sorted((r.i, r.a, r.id) for r in numbered(rows, "i", "a", "id").collect())
    assert [g[0] for g in got] == list(range(1000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert numbered(rows.limit(0), "i", "a").count() == 0


def test_signed_rank_test(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(b)) for k, n in (("few", 12), ("many", 80), ("tied", 20)) for a, b in (rng.normal(0.4, 1, (n, 2)) if k != "tied" else rng.integers(0, 4, (n, 2)))]
    got = {r.k: r.p for r in stats.signed_rank_test(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got == {k: pytest.approx(stats.signed_rank_p(np.array([x - y for g, x, y in rows if g == k]))) for k in got} and len(got) == 3


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, "click", float(i % 90)) for i in range(60)], "event_id long, user_id long, event_type string, value double")
    rows = rows.select("event_id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("event_id").cast("int"))).alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(streams.SCHEMA).parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(streams.acquisition_writer(str(tmp_path / "out"))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert streams.acquired(spark, f"{tmp_path}/out").count() == 3
    windows = streams.windowed_accuracy(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    windows.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == 60


def test_stream_keeps_first_trials(spark, tmp_path):
    """Batches out of order, one of them twice, leave what all events at once give; only two versions stay."""
    rng = np.random.default_rng(5)
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=int(m)) for m in rng.permutation(400)]
    rows = [(i, t, int(rng.integers(0, 8)), "ab"[i % 2], float(rng.choice([10.0, 50.0, 60.0])), "{}") for i, t in enumerate(at)]
    events = spark.createDataFrame(rows, streams.SCHEMA)
    write, folder = streams.acquisition_writer(str(tmp_path)), str(tmp_path)
    for number, k in enumerate([0, 1, 2, 2]):
        write(events.where(F.col("event_id") % 3 == k), min(number, 2))
    want = trials.acquisition(trials.from_events(events), ["method", "function"])
    assert sorted(map(tuple, streams.acquired(spark, folder).collect())) == sorted(map(tuple, want.collect()))
    assert streams.versions(spark, f"{folder}/first") == [1, 2] and spark.read.parquet(f"{folder}/first/version=2").count() <= 16 * trials.TRIALS


def test_depth_by_brackets(spark):
    """As the parser has it: names of functions and empty lists have no depth, branches and lists have; no program is left out."""
    texts = ["x", "[]", "[1 2]", "[ ]", "(λ (xs) xs)", "(λ (x y) (+ x y))", "(λ (xs) (map (λ (x) (* x 2)) (filter (λ (x) (> x 10)) xs)))", "(if true [1] (cons 1 []))", "(λ (xs) (concat [[1] []] xs))"]
    rows = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)] + [(0, None), (None, "x")], "g int, program string")
    got = {(r.g, r.depth): (r.n, r.share) for r in corpus.depth_distribution(rows, ["g"]).collect()}
    want = collections.Counter((i % 2, syntax.depth(syntax.parse(t))) for i, t in enumerate(texts)) + collections.Counter({(None, 0): 1})
    assert {k: n for k, (n, _) in got.items()} == want
    assert all(share == pytest.approx(n / sum(m for (g, _), m in want.items() if g == k[0])) for k, (n, share) in got.items())


def test_label_fractions(spark):
    """Sequences never acquired or not in the bundle are out; rows without tokens count for no word; words that none has are there."""
    acquired = spark.createDataFrame([(1, 3), (2, 12), (3, 1), (4, 2), (5, 2)], "function long, acquired_on int")
    bundle = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None), (5, ["b", "b"]), (9, ["c"])], "function long, tokens array<string>")
    kept = trials.acquired_in(acquired, bundle.union(bundle), ["function"])
    assert sorted(values(kept, "function")) == [1, 3, 5]
    rows = kept.join(bundle, "function").withColumn("g", F.when(F.col("function") == 5, 2).otherwise(1))
    got = {(r.g, r.label): r.share for r in trials.label_fractions(rows, ["g"], F.col("tokens"), ["a", "b", "c"]).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.5, (1, "c"): 0.0, (2, "a"): 0.0, (2, "b"): 1.0, (2, "c"): 0.0}
