"""Simplification of a corpus of programs, with the statistics that tell whether it may be trusted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dsl import syntax
from ..dsl.simplify import simplify

FAILED_SHARE = 0.001


def simplify_corpus(programs: DataFrame) -> DataFrame:
    """program, size, original_program, original_size, reduction_ratio; texts that are no closed programs keep NULL sizes and ratio."""
    at = programs.columns.index("program")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(at).to_pylist():
                try:
                    node = syntax.parse(text or "")
                    out = simplify(node)
                    a, b = syntax.size(node), syntax.size(out)
                    rows.append((syntax.show(out), b, text, a, 1 - b / a))
                except (ValueError, RecursionError):
                    rows.append((text, None, text, None, None))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["program", "size", "original_program", "original_size", "reduction_ratio"])

    return programs.mapInArrow(run, "program string, size int, original_program string, original_size int, reduction_ratio double")


def report(simplified: DataFrame, changed_behaviour: DataFrame) -> DataFrame:
    """Counts and mean ratio; raises where too many programs behave otherwise than before."""
    total, wrong = simplified.count(), changed_behaviour.count()
    if total and wrong / total > FAILED_SHARE:
        raise ValueError(f"{wrong} of {total} programs changed their behaviour")
    smaller = F.col("size") < F.col("original_size")
    return simplified.agg(F.count(F.lit(1)).alias("programs"), F.sum(smaller.cast("int")).alias("smaller"), F.avg("reduction_ratio").alias("mean_ratio"))
