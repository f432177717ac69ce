"""Variants: drawn once for a row, well-typed, and of other meaning than the program."""

from pyspark.sql import functions as F

from lambdalake.dsl import interpreter, syntax, types
from lambdalake.dsl.primitives import SIGNATURES
from lambdalake.operators import variants


def test_templates_have_meanings_of_their_own():
    for name, primitive, text, a, a_most, b, b_most in variants.TEMPLATES:
        assert a <= a_most and b <= b_most and primitive in SIGNATURES, name
        for x, y in ((a, b), (a_most, b_most)):
            macro = syntax.parse(text.replace("{a}", str(x)).replace("{b}", str(y)))
            t = types.show(types.infer(macro, SIGNATURES))
            assert t, name


def test_variants(spark):
    programs = spark.createDataFrame([(i, f"(λ (x) (take {i} (reverse (map (λ (y) (+ y {i})) x))))") for i in range(1, 6)] + [(9, None), (10, "(λ (x) x)")], "i int, program string")
    got = variants.variants(programs, "i").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, variants.variants(programs.repartition(3), "i").collect()))
    wanted = [t[0] for t in variants.TEMPLATES if t[1] in ("take", "reverse", "map", "+")]
    assert sorted((r.i, r.template) for r in got) == sorted((i, t) for i in range(1, 6) for t in wanted)
    differing = set()
    for r in got:
        macro = interpreter.function(r.macro)
        own = {"take": lambda n, us: macro(n, us), "reverse": macro, "map": macro, "+": macro}
        base = f"(λ (x) (take {r.i} (reverse (map (λ (y) (+ y {r.i})) x))))"
        changed = syntax.rewrite(syntax.parse(base), lambda n: syntax.Var("__own") if isinstance(n, syntax.Var) and n.name == r.primitive else n)
        call = interpreter.build(changed)({"__own": own[r.primitive]})
        inputs = [[3, 1, 2], [5, 4, 3, 2, 1], [1, 2, 3, 4, 5, 6, 7, 8]]
        assert interpreter.outputs(r.variant, inputs) == [call(x) for x in inputs], r.variant
        if interpreter.outputs(r.variant, inputs) != interpreter.outputs(base, inputs):
            differing.add(r.template)
    assert differing == set(wanted) - {"take-until-full"} or differing == set(wanted)
    other = {r.macro for r in variants.variants(programs, "i", seed=1).collect()}
    assert other != {r.macro for r in got}
    only = variants.variants(programs, "i", variants.templates(spark, [("t", "reverse", "(λ (us) us)", 0, 0, 0, 0)]))
    assert [r.variant for r in only.where(F.col("i") == 1).collect()] == ["( λ ( x ) ( take 1 ( (λ (us) us) ( map ( λ ( y ) ( + y 1 ) ) x ) ) ) )"]
