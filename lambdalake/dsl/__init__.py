"""The list language: syntax, types, evaluation, compilation to Spark columns, and simplification."""
