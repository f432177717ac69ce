"""The list language: front end, values of all primitives by two evaluators, simplification, variations."""

import random

import pytest
from pyspark.sql import functions as F

from lambdalake.dsl import compiler, interpreter, simplify, syntax, types, variations
from lambdalake.dsl.primitives import SIGNATURES, SMALL, Grammar, get_grammar
from lambdalake.operators.corpus import TEST_SUITE, random_program

LIST = types.ListOf(types.INT)


def both(spark, programs, inputs=TEST_SUITE):
    """Values by compiled columns and by the interpreter."""
    rows = spark.createDataFrame(list(enumerate(inputs)), "idx int, xs array<bigint>").coalesce(1)
    columns = [compiler.column(p, "xs", types=[LIST]).alias(f"p{i}") for i, p in enumerate(programs)]
    got = rows.select("idx", *columns).orderBy("idx").collect()
    return [[r[f"p{i}"] for r in got] for i in range(len(programs))], [interpreter.outputs(p, inputs) for p in programs]


def test_parse_and_print():
    for text in ["(λ (x y) (+ x y))", "(if true 1 [])", "[1 [2] x]", "(f)", "((λ (x) x) 3)"]:
        assert syntax.show(syntax.parse(text)) == text
    assert syntax.parse("(lambda x y (+ x y)) # a comment") == syntax.parse("(λ (x y) (+ x y))")
    assert syntax.parse("(- x 1)").function == syntax.Var("-") and syntax.parse("(f -1)").args == (syntax.Var("-1"),)


@pytest.mark.parametrize("text", ["", "(", "(if true 1)", "()", "(λ (1) x)", "1 2", "(λ", "]"])
def test_parse_errors(text):
    with pytest.raises(syntax.ProgramError):
        syntax.parse(text)


def test_measures():
    node = syntax.parse("(λ (x) (map (λ (y) (+ y int_hole)) x))")
    assert (syntax.size(node), syntax.depth(node), syntax.holes(node)) == (7, 4, 1)
    assert syntax.size(syntax.parse("(length x)")) == 2 and syntax.size(syntax.parse("(+ x 1)")) == 3
    assert syntax.show(syntax.canonical(node)) == "(λ (_p0) (map (λ (_p1) (+ _p1 int_hole)) _p0))"
    assert syntax.free(node) == {"map", "+"} and not syntax.uses(node, "x") and syntax.uses(node.body, "x")
    assert syntax.show(syntax.fill(syntax.parse("[int_hole int_hole int_hole]"), [5, 3])) == "[5 3 5]"


def test_external_form():
    arity = lambda name: {"fold": [2, 0, 0], "map": [1, 0]}.get(name, [])
    node = syntax.from_de_bruijn("(lambda (fold (lambda (lambda (+ $0 $1))) 0 (map (lambda (* $0 $0)) $0)))", arity)
    assert interpreter.evaluate(node, [1, 2, 3]) == 14
    assert interpreter.evaluate(syntax.from_de_bruijn("(lambda (concat empty $0))"), [4]) == [4]


def test_types():
    infer = lambda text: types.show(types.infer(syntax.parse(text), SIGNATURES))
    assert infer("(λ (xs) (map (λ (x) (> x 2)) xs))") == "list[int] -> list[bool]"
    assert infer("(+ 1)") == "int -> int" and types.pretty(types.read("[int]->int")) == "[Int] -> Int"
    for bad in ["(+ 1 true)", "[1 true]", "(if 1 2 3)", "(first 3)", "(λ (f) (f f))", "(nope 1)"]:
        with pytest.raises(syntax.ProgramError):
            types.infer(syntax.parse(bad), SIGNATURES)
    assert {types.show(i["T1"]) for i in types.instantiations("[T1],[T1]->[[T1]]")} == {"int"}
    assert len(types.instantiations("T1,T1->bool")) == 3


def test_grammars():
    assert len(SIGNATURES) == 57 and len(SMALL) == 31 and list(get_grammar("small").signatures) == [n for n in SIGNATURES if n in SMALL]
    g = Grammar(["take", "drop", "length"])
    assert g.find_matching("[int]->int") == ["length"] and set(g.shuffle_names(3)) == set(g.base)
    g.reset_names()
    assert g.names["take"] == "take"
    with pytest.raises(ValueError):
        get_grammar("none")


def test_primitives_agree(spark):
    """All primitives, with places and counts inside, outside and below 0, and failing parts."""
    programs = []
    for n in ("drop", "droplast", "take", "takelast", "nth", "cut_idx"):
        programs += [f"(λ (x) ({n} (- {k} 3) x))" for k in range(8)]
    for n in ("slice", "cut_slice", "swap"):
        programs += [f"(λ (x) ({n} (- {i} 2) (- {j} 2) x))" for i in range(5) for j in (0, 2, 5)]
    programs += [f"(λ (x) (insert 9 (- {i} 4) x))" for i in range(9)] + [f"(λ (x) (splice [7 8] (- {i} 4) x))" for i in range(9)]
    programs += [f"(λ (x) (range {a} {b} (- {s} 2)))" for a in (0, 3) for b in (0, 2, 5) for s in range(5)]
    programs += [f"(λ (x) (map (λ (y) ({o} y (- {k} 2))) x))" for o in ("/", "%") for k in range(5)]
    programs += [
        "(λ (x) (and (> (first x) 1) true))", "(λ (x) (or true (> (first x) 1)))", "(λ (x) (if (> (first x) 2) [1] x))", "(λ (x) (repeat 1 (- (first x) 4)))",
        "(λ (x) (zip x (drop 1 x)))", "(λ (x) (flatten (zip x x)))", "(λ (x) (sort (λ (y) (% y 3)) x))", "(λ (x) (group is_even x))", "(λ (x) (foldi (λ (a y i) (+ a (* y i))) 0 x))",
        "(λ (x) (fold (λ (a y) (/ a y)) 100 x))", "(λ (x) (filteri (λ (i y) (> y i)) x))", "(λ (x) (mapi (λ (y i) (- y i)) x))", "(λ (x) (find (λ (y) (== y 3)) x))", "(λ (x) (count is_odd x))",
        "(λ (x) (cut_val 7 x))", "(λ (x) (cut_vals 8 x))", "(λ (x) (replace 1 9 x))", "(λ (x) (unique x))", "(λ (x) (map (+ 1) x))", "(λ (x) (map (λ (y) (map (λ (z) (* y z)) x)) x))",
        "(λ (x) (product (map (λ (y) 1000000) (range 1 5 1))))", "(λ (x) (length (repeat 1 1001)))", "(λ (x) (length (concat (repeat 1 600) (repeat 2 401))))", "(λ (x) (== (zip x x) []))",
        "(λ (x) (max x))", "(λ (x) (min x))", "(λ (x) (is_in x 3))", "(λ (x) (last x))", "(λ (x) (singleton (second x)))", "(λ (x) (third x))", "(λ (x) [(first x) 1])", "(λ (x) ((if (> 1 0) first last) x))",
    ]
    native, plain = both(spark, programs)
    assert native == plain


def test_random_programs_agree(spark):
    programs = [syntax.show(random_program(seed, "list[int]", 3)) for seed in range(30)]
    native, plain = both(spark, programs)
    assert native == plain


def test_null_input_is_failure(spark):
    row = spark.createDataFrame([(None,)], "xs array<bigint>")
    for p in ["(λ (x) (length x))", "(λ (x) (cons 1 x))", "(λ (x) (singleton (sum x)))", "(λ (x) (concat x [1]))", "(λ (x) (takelast 2 x))", "(λ (x) (fold (λ (a y) a) 1 x))"]:
        assert row.select(compiler.column(p, "xs", types=[LIST])).first()[0] is None


def test_own_primitive(spark):
    registry = compiler.Registry()

    @registry.primitive("int->int")
    def twice(x):
        return x * 2

    column = compiler.column("(λ (x) (map twice x))", "xs", types=[LIST], registry=registry)
    assert spark.createDataFrame([([1, 2],)], "xs array<bigint>").select(column).first()[0] == [2, 4]


#: Programs and the sizes that simplification must reach (fixed values).
@pytest.mark.parametrize(
    ("text", "size"),
    [
        ("(λ (_p0) (reverse (reverse (concat _p0 []))))", 2),
        ("(λ (_p0) (length (reverse (reverse (repeat 0 5)))))", 2),
        ("(λ (_p0) (sum (map (λ (_p1) (* _p1 1)) (filter (λ (_p1) true) (reverse (reverse (map (λ (_p1) _p1) _p0)))))))", 3),
        ("(λ (_p0) (cons (product (repeat 10 8)) _p0))", 4),
        ("(λ (_p0) (length (reverse (concat (map (λ (_p1) (+ _p1 0)) _p0) (repeat 8 10)))))", 5),
    ],
)
def test_simplify_sizes(text, size):
    assert syntax.size(simplify.simplify(text)) == size


def test_simplify_leaves_and_refuses():
    for text in ["(λ (x) (reverse x))", "(λ (x) (* (first x) 0))", "(λ (x) (length (map (λ (y) (/ y 0)) x)))", "(λ (x) (and (> (first x) 0) false))"]:
        assert syntax.size(simplify.simplify(text)) == syntax.size(syntax.parse(text))
    with pytest.raises(syntax.ProgramError):
        simplify.simplify("(λ (x) (take int_hole x))")


def test_rules_are_sound():
    assert len(simplify.DEFAULT_RULES) == 41
    assert {r.name for r in simplify.DEFAULT_RULES if simplify.validate(r)} == {"length-of-map"}
    assert simplify.validate(simplify.Rule.read("drops", "(* ?x 0)", "0")) and simplify.validate(simplify.Rule.read("wrong", "(+ ?x ?x)", "?x"))


def test_graph_congruence():
    g = simplify.Graph()
    a, b = g.add(syntax.parse("(f x)")), g.add(syntax.parse("(f y)"))
    assert g.find(a) != g.find(b)
    g.merge(g.add(syntax.parse("x")), g.add(syntax.parse("y")))
    g.rebuild()
    assert g.find(a) == g.find(b)
    assert len(list(g.match(syntax.parse("(f ?a)"), a, {}))) >= 1


def test_simplify_keeps_behaviour():
    for seed in range(60):
        p = random_program(seed, "list[int]", 4)
        assert interpreter.outputs(simplify.simplify(p), TEST_SUITE) == interpreter.outputs(p, TEST_SUITE)


def test_variations():
    every = variations.registry()
    assert {t.name for t in every} == set(SIGNATURES) and len(every) > 216
    rng = random.Random(0)
    for t in every:
        types.infer(variations.draw(t, rng), SIGNATURES)
    program = variations.apply("(λ (x) (take 2 x))", {"take": syntax.parse("(λ (n xs) (reverse (take n xs)))")})
    assert interpreter.evaluate(program, [1, 2, 3]) == [2, 1]
    assert variations.sample(1) == variations.sample(1)


def test_no_python_in_plan(spark):
    plan = spark.range(1).select(F.array(F.col("id")).alias("xs")).select(compiler.column("(λ (x) (sort (λ (y) y) (map (+ 1) x)))", "xs", types=[LIST]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
