"""Vocabulary metrics: the corpus is cut into units (lines, functions, lexemes), all units are encoded in
parallel, and each metric is an average over one kind of unit."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.tokenizer import corpus
from lodewright.tokenizer.model import Vocabulary

# The hard gates (direction, bound).
GATES: dict[str, tuple[str, float]] = {
    "vocab_size": ("exact", 32768),
    "round_trip_exactness": ("exact", 1.0),
    "byte_fallback_success": ("exact", 1.0),
    "unicode_behavior": ("exact", 1.0),
    "tokens_per_python_line": ("lower", 22.0),
    "tokens_per_function": ("lower", 450.0),
    "identifier_fragmentation": ("lower", 4.0),
    "operator_fragmentation": ("lower", 2.0),
    "import_fragmentation": ("lower", 18.0),
    "numeric_literal_handling": ("higher", 0.90),
    "compression_ratio": ("higher", 1.35),
}
NUMBER_TOKENS = 6


def lexemes(source: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of names, operators and numbers; a source the lexer rejects has none."""
    kinds = {tokenize.NAME: "name", tokenize.OP: "operator", tokenize.NUMBER: "number"}
    try:
        return [(kinds[t.type], t.string) for t in list(tokenize.generate_tokens(io.StringIO(source).readline)) if t.type in kinds and t.string]
    except (tokenize.TokenError, SyntaxError):
        return []


def functions(source: str) -> list[str]:
    """Source lines of each function, nested ones too."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return []
    lines = source.splitlines()
    return ["\n".join(lines[n.lineno - 1 : n.end_lineno]) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]


def units_of(source: str) -> list[tuple[str, str]]:
    lines = [x for x in source.splitlines() if x.strip()]
    imports = [x for x in lines if x.strip().startswith(("import ", "from "))]
    return [*(("line", x) for x in lines), *(("import", x) for x in imports), *(("function", x) for x in functions(source)), *lexemes(source)]


def _measure(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = units_of(text) if name.startswith("python/") else []
                for kind, piece in [*units, ("text", text)]:
                    ids = vocabulary.encode(piece)
                    rows.append((name, kind, len(ids), len(piece.encode()), vocabulary.decode(ids) == piece))
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["name", "kind", "n_tokens", "n_bytes", "exact"])

    return run


def units(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``name, kind, n_tokens, n_bytes, exact`` of every unit of ``texts`` (``name, text``)."""
    return texts.select("name", "text").mapInArrow(_measure(vocabulary), "name string, kind string, n_tokens int, n_bytes int, exact boolean")


def report(spark: SparkSession, vocabulary: Vocabulary, texts: DataFrame | None = None) -> DataFrame:
    """One row with all metrics, over ``texts`` (default: the evaluation corpus)."""
    src = corpus.evaluation(spark).select("name", "text") if texts is None else texts.select("name", "text")
    extra = spark.createDataFrame([(f"fallback/{k}", t) for k, t in enumerate(corpus.FALLBACK)], "name string, text string")
    u = units(src.unionByName(extra), vocabulary)
    of = lambda kind: F.col("kind") == kind
    mean = lambda kind: F.coalesce(F.avg(F.when(of(kind), F.col("n_tokens"))), F.lit(0.0))
    fallback = F.col("name").startswith("fallback/")
    own = of("text") & ~fallback
    uni = own & (F.col("name").startswith("math/") | F.col("name").startswith("stem/") | F.col("name").contains("unicode"))
    share = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("exact").cast("double"))), F.lit(1.0))
    return u.agg(
        F.lit(vocabulary.size).alias("vocab_size"), mean("line").alias("tokens_per_python_line"), mean("function").alias("tokens_per_function"),
        mean("name").alias("identifier_fragmentation"), mean("operator").alias("operator_fragmentation"), mean("import").alias("import_fragmentation"),
        F.coalesce(F.avg(F.when(of("number"), (F.col("n_tokens") <= NUMBER_TOKENS).cast("double"))), F.lit(1.0)).alias("numeric_literal_handling"),
        share(uni).alias("unicode_behavior"), share(own).alias("round_trip_exactness"),
        F.coalesce(F.sum(F.when(own, F.col("n_bytes"))) / F.nullif(F.sum(F.when(own, F.col("n_tokens"))), F.lit(0)), F.lit(0.0)).alias("compression_ratio"),
        share(of("text") & fallback).alias("byte_fallback_success"),
    )


def failures(metrics: dict[str, float]) -> list[str]:
    """Names of the hard gates that are not met."""
    bad = {"exact": lambda v, b: v != b, "lower": lambda v, b: v > b, "higher": lambda v, b: v < b}
    return [n for n, (direction, bound) in GATES.items() if bad[direction](metrics[n], bound)]


def ranking(metrics: dict[str, float], name: str) -> tuple:
    """Order among candidates that pass: fewer tokens a line, fewer a name, better compression, name."""
    return metrics["tokens_per_python_line"], metrics["identifier_fragmentation"], -metrics["compression_ratio"], name
