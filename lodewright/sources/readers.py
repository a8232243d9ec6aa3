"""Readers: parquet and JSONL scans, dispatch by suffix, reference texts, fixtures, registry."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewright.config import DEFAULT, Thresholds
from lodewright.operators import ingest
from lodewright.operators.license import inventory

REFERENCE_FILES = ("humaneval.txt", "mbpp.txt")


def read_parquet(spark: SparkSession, files: list[str], columns: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(*files)
    df = df.select(*[c for c in columns if c in df.columns]) if columns else df
    return df.limit(max_rows) if max_rows is not None else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None, max_rows: int | None = None) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.json(path)
    return df.limit(max_rows) if max_rows is not None else df


def read_source(spark: SparkSession, source: dict, root: str, max_rows: int | None = None) -> tuple[DataFrame | None, str | None]:
    """``(rows, error)`` of a source's pre-staged files under ``root``: all parquet, or one JSONL file, or what its ``format`` names. Errors are returned, not raised."""
    files = [str(Path(root) / f) for f in source.get("files") or source.get("hf_files") or []]
    try:
        if files and all(f.endswith(".parquet") for f in files):
            return read_parquet(spark, files, source.get("columns") or source.get("hf_columns"), max_rows), None
        if len(files) == 1 and files[0].endswith(".jsonl"):
            return read_jsonl(spark, files[0], max_rows=max_rows), None
        kind = source.get("format")
        if files and kind:  # any other format that Spark reads
            df = spark.read.format(kind).options(**source.get("options", {})).load(files)
            return (df.limit(max_rows) if max_rows is not None else df), None
        return None, "no parquet files, not a single jsonl file and no format named"
    except Exception as e:  # noqa: BLE001  missing or unreadable files
        return None, f"{type(e).__name__}: {e}".splitlines()[0]


def collect_documents(spark: SparkSession, source: dict, root: str, collection_date: str, *, cap: int = 8, max_docs: int | None = None, t: Thresholds = DEFAULT) -> tuple[DataFrame | None, DataFrame | None, str | None]:
    """``(documents, removed, error)`` of an admitted source. Sources that are rejected, not verified or without files give an error."""
    if source.get("decision") == "reject" or source.get("identity_status") != "verified":
        return None, None, "source is not admitted"
    rows, error = read_source(spark, source, root)
    if error is not None:
        return None, None, error
    docs, removed = ingest.documents_of(ingest.number_rows(rows), source, collection_date, cap=cap, t=t, max_docs=max_docs)
    return docs, removed, None


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Heterogeneous JSONL rows with all known columns, and ``row``, the line's number."""
    kinds = {"source_id": "string", "text": "string", "problem": "string", "generated_solution": "string", "problem_id": "string", "is_correct": "boolean", "language_tag": "string", "score": "double", "solution": "string", "id": "string"}
    return ingest.number_rows(spark.read.schema(", ".join(f"{k} {v}" for k, v in kinds.items())).json(path))


def read_references(spark: SparkSession, directory: str, names: tuple[str, ...] = REFERENCE_FILES, first_ord: int = 0) -> tuple[DataFrame, list[str]]:
    """``(refs, missing)``: each file is one reference ``ref_id, ref_ord, text``; missing names are reported."""
    there = [n for n in names if (Path(directory) / n).is_file()]
    missing = [n for n in names if n not in there]
    if not there:
        return spark.createDataFrame([], "ref_id string, ref_ord bigint, text string"), missing
    order = F.create_map(*[x for k, n in enumerate(there) for x in (F.lit(n), F.lit(first_ord + k))])
    df = spark.read.text([str(Path(directory) / n) for n in there], wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return df.select(F.col("name").alias("ref_id"), order[F.col("name")].cast("bigint").alias("ref_ord"), "text"), missing


def reference_text(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One row ``text``: the fields of a row joined by a line end, rows by an empty line, in order.

    For benchmark files, which are small by nature.
    """
    row = F.concat_ws("\n", *[F.when(F.col(f).cast("string") != "", F.col(f).cast("string")) for f in fields])
    rows = df.select(F.struct(F.col(order).alias("o"), row.alias("t")).alias("r"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n\n").alias("text"))


def load_mapping(path: str) -> dict:
    """A mapping from a JSON file, or from YAML where that parser is installed."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package; use JSON") from e
        data = yaml.safe_load(raw)
    else:
        data = json.loads(raw)
    if not isinstance(data, dict):
        raise ValueError(f"{path}: not a mapping")
    return data


def load_registry(path: str) -> dict:
    """Source registry: a mapping with ``sources``."""
    data = load_mapping(path)
    if not isinstance(data.get("sources"), list):
        raise ValueError(f"{path}: a registry is a mapping with a list of sources")
    return data


def registry_table(spark: SparkSession, registry: dict) -> DataFrame:
    """Inventory (license gate applied) of a registry. Claimed fields count where plain ones are missing."""
    cols = ("source_id", "domain", "language", "license", "provenance", "url", "collection_date", "contamination_risk", "identity_status", "decision", "block_reason", "stem_bucket")
    rows = []
    for s in registry["sources"]:
        claimed = {"license": s.get("claimed_license"), "url": s.get("claimed_url"), "provenance": s.get("claimed_origin")}
        rows.append(tuple(None if (v := s.get(c, claimed.get(c))) is None else str(v) for c in cols))
    return inventory(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)))
