"""Enumeration with the names in scope, against all programs of a size worked out by the interpreter."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from lambdalake.dsl import interpreter, syntax
from lambdalake.operators import corpus as C
from lambdalake.plans import banks
from lambdalake.plans.enumeration import compositions

ONLY = ["+", "map", "length"]


def everything(kind, size, names):
    """All programs of ONLY's grammar, by type and size."""
    if size == 1:
        return {"int": ["int_hole"], "list[int]": ["[]", "x"]}[kind] + [n for n in names if kind == "int"]
    out = []
    if kind == "int":
        out += [f"(+ {a} {b})" for i, j in compositions(size - 1, 2) for a in everything("int", i, names) for b in everything("int", j, names)]
        out += [f"(length {a})" for a in everything("list[int]", size - 1, names)]
    else:
        v = f"_p{len(names)}"
        out += [f"(map (λ ({v}) {f}) {a})" for i, j in compositions(size - 1, 2) if i > 1 and len(names) < 3 for f in everything("int", i - 1, [*names, v]) for a in everything(kind, j, names)]
    return out


def values(program, inputs=C.TEST_SUITE):
    node = syntax.fill(syntax.Lam(("x",), syntax.parse(program)), C.HOLE_PROBES)
    return tuple(C.value_text(v) for v in interpreter.outputs(node, inputs))


@pytest.fixture(scope="module")
def bank(spark, tmp_path_factory):
    return banks.Enumerator(spark, str(tmp_path_factory.mktemp("bank")), only=ONLY)


def test_all_behaviours_of_size_five(bank):
    got = bank.bank(5).collect()
    for r in got:
        assert tuple(r.fp) == values(r.program), r.program
        assert syntax.size(syntax.parse(r.program)) == r.size and r.program.count("int_hole") == r.holes
    for kind in ("int", "list[int]"):
        want = {values(p) for s in range(1, 6) for p in everything(kind, s, [])}
        assert {tuple(r.fp) for r in got if r.type == kind} == {w for w in want if any(v is not None for v in w)}
    assert any("_p1" in p for p in (r.program for r in bank.bank(2, banks.Context((("_p0", "int"), ("_p1", "int")), 2)).collect()))
    assert {"(map (λ (_p0) (length x)) x)", "(map (λ (_p0) (+ _p0 _p0)) x)"} <= {r.program for r in bank.bank(6).where("type = 'list[int]'").collect()}


def test_corpus_is_filtered(bank):
    kept = {r.program for r in bank.corpus(4).collect()}
    assert kept == {f"(λ (x) {r.program})" for r in bank.bank(4).where(C.good(F.col("fp"))).collect()}
    assert "(λ (x) x)" in kept and "(λ (x) [])" not in kept


def test_goes_on_after_a_kill(spark, tmp_path, bank, monkeypatch):
    """Killed between writing level 4 and its record, a run goes on from level 3 and equals one that was not."""
    store, commit = str(tmp_path / "bank"), banks.Enumerator.commit

    def killed(self, context, size, counts):
        if size == 4 and not context.names:
            raise KeyboardInterrupt
        commit(self, context, size, counts)

    monkeypatch.setattr(banks.Enumerator, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        banks.Enumerator(spark, store, only=ONLY).bank(5)
    monkeypatch.undo()
    built = []
    build = banks.Enumerator.build
    monkeypatch.setattr(banks.Enumerator, "build", lambda self, context, size: built.append((context.depth, size)) or build(self, context, size))
    again = banks.Enumerator(spark, store, only=ONLY).bank(5).collect()
    assert [x for x in built if x[0] == 0] == [(0, 4), (0, 5)]
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, bank.bank(5).collect()), key=str)
    with pytest.raises(ValueError):
        banks.Enumerator(spark, store, only=["+"]).bank(2)


def test_contextual_fingerprint(spark):
    context = banks.Context((("a", "int"), ("ys", "list[int]")), 1)
    rows = spark.createDataFrame([(2,), (0,)], "k long").withColumn("fp", banks.contextual_fingerprint("(cons (/ a k) (concat ys x))", context, {"k": F.col("k")}))
    for r in rows.collect():
        want = []
        for x, a, ys in itertools.product(C.TEST_SUITE, C.PROBES["int"], C.PROBES["list[int]"]):
            want.append(json.dumps([a // r.k, *ys, *x], separators=(",", ":")) if r.k else None)
        assert list(r.fp) == want
