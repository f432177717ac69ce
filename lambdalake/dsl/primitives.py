"""Names and signatures of the 57 primitives and the presets of them (fixed values)."""

from __future__ import annotations

SIGNATURES: dict[str, str] = {
    "+": "int,int->int", "-": "int,int->int", "*": "int,int->int", "/": "int,int->int", "%": "int,int->int",
    "<": "int,int->bool", ">": "int,int->bool", "==": "T1,T1->bool",
    "and": "bool,bool->bool", "or": "bool,bool->bool", "not": "bool->bool",
    "is_even": "int->bool", "is_odd": "int->bool",
    "singleton": "T1->[T1]", "repeat": "T1,int->[T1]", "range": "int,int,int->[int]",
    "cons": "T1,[T1]->[T1]", "append": "[T1],T1->[T1]", "concat": "[T1],[T1]->[T1]", "zip": "[T1],[T1]->[[T1]]",
    "first": "[T1]->T1", "second": "[T1]->T1", "third": "[T1]->T1", "last": "[T1]->T1", "nth": "int,[T1]->T1",
    "insert": "T1,int,[T1]->[T1]", "replace": "int,T1,[T1]->[T1]", "swap": "int,int,[T1]->[T1]",
    "cut_idx": "int,[T1]->[T1]", "cut_val": "T1,[T1]->[T1]", "cut_vals": "T1,[T1]->[T1]",
    "drop": "int,[T1]->[T1]", "droplast": "int,[T1]->[T1]", "take": "int,[T1]->[T1]", "takelast": "int,[T1]->[T1]",
    "slice": "int,int,[T1]->[T1]", "cut_slice": "int,int,[T1]->[T1]", "splice": "[T1],int,[T1]->[T1]",
    "is_in": "[T1],T1->bool", "length": "[T1]->int", "max": "[int]->int", "min": "[int]->int",
    "product": "[int]->int", "sum": "[int]->int", "reverse": "[T1]->[T1]", "flatten": "[[T1]]->[T1]",
    "map": "(T1->T2),[T1]->[T2]", "mapi": "(T1,int->T2),[T1]->[T2]",
    "filter": "(T1->bool),[T1]->[T1]", "filteri": "(int,T1->bool),[T1]->[T1]",
    "fold": "(T2,T1->T2),T2,[T1]->T2", "foldi": "(T2,T1,int->T2),T2,[T1]->T2",
    "count": "(T1->bool),[T1]->int", "find": "(T1->bool),[T1]->[int]",
    "unique": "[T1]->[T1]", "sort": "(T1->int),[T1]->[T1]", "group": "(T1->T2),[T1]->[[T1]]",
}
MAX_LIST = 1000
#: The small preset keeps these, in the order above (fixed values).
SMALL = [
    "+", "-", "*", "/", "%", "<", ">", "==", "and", "or", "not", "is_even", "is_odd", "singleton", "range", "cons",
    "concat", "first", "last", "nth", "drop", "take", "slice", "length", "max", "min", "sum", "reverse", "map", "filter", "fold",
]


class Grammar:
    """A set of primitives under their own or other names."""

    def __init__(self, names: list[str] | None = None, signatures: dict[str, str] | None = None):
        known = signatures or SIGNATURES
        self.base = {n: known[n] for n in known if names is None or n in names}
        self.names = {n: n for n in self.base}

    @property
    def signatures(self) -> dict[str, str]:
        return {self.names[n]: s for n, s in self.base.items()}

    def subset(self, names: list[str]) -> Grammar:
        return Grammar(names, self.base)

    def use_names(self, names: dict[str, str]) -> None:
        if len({**self.names, **names}.values()) != len({*{**self.names, **names}.values()}):
            raise ValueError("two primitives of one name")
        self.names |= names

    def shuffle_names(self, seed: int) -> dict[str, str]:
        import random

        to = list(self.base)
        random.Random(seed).shuffle(to)
        self.names = dict(zip(self.base, to, strict=True))
        return dict(self.names)

    def reset_names(self) -> None:
        self.names = {n: n for n in self.base}

    def find_matching(self, signature: str) -> list[str]:
        """Primitives whose type fits a wanted one, such as ``[int]->int``."""
        from . import types as T

        out = []
        for n in self.base:
            run = T.Inference(self.base)
            try:
                run.unify(run.signature(n), T.read(signature))
            except ValueError:
                continue
            out.append(self.names[n])
        return out


GRAMMARS = {"default": Grammar(), "small": Grammar(SMALL)}


def get_grammar(name: str) -> Grammar:
    if name not in GRAMMARS:
        raise ValueError(f"no grammar {name}; there are {', '.join(GRAMMARS)}")
    return GRAMMARS[name]
