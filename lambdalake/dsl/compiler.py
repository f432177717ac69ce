"""From a program to a Spark column, so that Catalyst plans it like any other expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..operators.primitives import BUILDERS, all_known, let, lit, only
from . import syntax as S
from . import types as T
from .primitives import SIGNATURES

SPARK = {T.INT: ST.LongType(), T.BOOL: ST.BooleanType()}


def spark_type(t: T.Type) -> ST.DataType:
    """The column type of a value; what stays open is int."""
    if isinstance(t, T.ListOf):
        return ST.ArrayType(spark_type(t.item), True)
    if isinstance(t, T.Unknown):
        return SPARK[T.INT]
    if isinstance(t, T.Fn):
        raise S.ProgramError("a function is not a column")
    return SPARK[t]


def from_spark(t: ST.DataType) -> T.Type:
    if isinstance(t, ST.ArrayType):
        return T.ListOf(from_spark(t.elementType))
    return T.BOOL if isinstance(t, ST.BooleanType) else T.INT


class Registry:
    """Primitives by name with signature and column builder; users add their own."""

    def __init__(self):
        self.signatures, self.builders = dict(SIGNATURES), dict(BUILDERS)

    def add(self, name: str, signature: str, builder: Callable[..., Column]) -> None:
        T.read(signature)
        self.signatures[name], self.builders[name] = signature, builder

    def primitive(self, signature: str, name: str | None = None) -> Callable:
        """Decorator form of ``add``."""

        def keep(builder: Callable[..., Column]) -> Callable[..., Column]:
            self.add(name or builder.__name__, signature, builder)
            return builder

        return keep

    def load(self, module: object) -> None:
        """All of a module's functions that carry a ``signature``."""
        for name, value in vars(module).items():
            if callable(value) and hasattr(value, "signature"):
                self.add(name, value.signature, value)


DEFAULT = Registry()
Value = Column | Callable


class Compiler:
    def __init__(self, run: T.Inference, registry: Registry):
        self.run, self.registry = run, registry

    def type_of(self, node: S.Node) -> T.Type:
        return self.run.resolve(self.run.of[id(node)], T.INT)

    def go(self, node: S.Node, env: dict[str, Value]) -> Value:
        match node:
            case S.Num(value):
                return lit(value)
            case S.Bool(value):
                return F.lit(value)
            case S.Var(name):
                return env[name] if name in env else self.function(self.registry.builders[name], self.run.of[id(node)])
            case S.Items(items):
                kind = spark_type(self.type_of(node))
                if not items:
                    return F.array().cast(kind)
                parts = [self.go(x, env) for x in items]
                known = parts[0].isNotNull()
                for p in parts[1:]:
                    known = known & p.isNotNull()
                return only(known, F.array(*parts).cast(kind))
            case S.Lam(params, body):
                return self.curried(len(params), lambda *a: self.go(body, env | dict(zip(params, a, strict=True))))
            case S.If(c, a, b):
                return self.branch(self.go(c, env), self.go(a, env), self.go(b, env))
            case S.App(f, args):
                return self.apply(f, args, env)
        raise S.ProgramError(f"{node} has no column")

    @staticmethod
    def branch(condition: Column, yes: Value, no: Value) -> Value:
        """Lazy; a failed condition is a failure. Branches that are functions are chosen between when applied."""
        if isinstance(yes, Column):
            return F.when(condition, yes).when(~condition, no)
        return lambda *args: Compiler.branch(condition, yes(*args), no(*args))

    @staticmethod
    def curried(n: int, body: Callable, given: tuple = ()) -> Callable:
        """A function of n arguments that may be given over several calls, or with more for its result."""

        def call(*args: Value) -> Value:
            have = given + args
            if len(have) < n:
                return Compiler.curried(n, body, have)
            out = body(*have[:n])
            return out(*have[n:]) if len(have) > n else out

        return call

    def function(self, builder: Callable, t: T.Type) -> Callable:
        t, n = self.run.find(t), 0
        while isinstance(t, T.Fn):
            t, n = self.run.find(t.result), n + 1
        return self.curried(n, builder)

    def apply(self, f: S.Node, args: tuple[S.Node, ...], env: dict[str, Value]) -> Value:
        function = self.go(f, env)
        values = [self.go(a, env) for a in args]
        if isinstance(f, S.Var) and f.name not in env and isinstance(self.type_of_application(f, len(args)), T.Fn):
            out = function(*values)
            given = [v for v in values if isinstance(v, Column)]
            out.guard = all_known(*given) if given else None  # a function given a failure is one
            return out
        # What is not a name or constant is worked out once, then mentioned as often as the builder likes.
        return self.bind(list(zip(args, values, strict=True)), [], function)

    def type_of_application(self, f: S.Node, n: int) -> T.Type:
        t = self.run.find(self.run.of[id(f)])
        for _ in range(n):
            t = self.run.find(t.result)
        return t

    def bind(self, left: list[tuple[S.Node, Value]], done: list[Value], function: Callable) -> Value:
        if not left:
            out = function(*done)
            for guard in (getattr(v, "guard", None) for v in done if not isinstance(v, Column)):
                if guard is not None and isinstance(out, Column):
                    out = only(guard, out)
            return out
        (node, value), *rest = left
        if isinstance(node, S.App | S.If) and isinstance(value, Column) and isinstance(self.type_of(node), T.ListOf):
            return let(value, lambda v: self.bind(rest, [*done, v], function))
        return self.bind(rest, [*done, value], function)


def compile_function(program: str | S.Node, arguments: list[T.Type] | None = None, registry: Registry = DEFAULT) -> tuple[Callable[..., Column], T.Type]:
    """(function of columns, its type). ``arguments`` narrows the types of the program's parameters."""
    node = T.copy(S.parse(program) if isinstance(program, str) else program)
    run = T.Inference(registry.signatures)
    t = run.infer(node, {})
    at = t
    for a in arguments or []:
        at = run.find(at)
        if not isinstance(at, T.Fn):
            raise S.ProgramError("too many arguments")
        run.unify(at.argument, a)
        at = at.result
    value = Compiler(run, registry)
    t = run.resolve(t, T.INT)

    def function(*columns: Column) -> Column:
        out = value.go(node, {})
        return out(*columns) if columns else out

    return function, t


def column(program: str | S.Node, *arguments: Column | str, types: list[T.Type] | None = None, registry: Registry = DEFAULT) -> Column:
    """The program applied to columns: one native expression. A lost value (NULL) in is a failure (NULL) out."""
    columns = [F.col(a) if isinstance(a, str) else a for a in arguments]
    function, _ = compile_function(program, types, registry)
    return function(*columns)
