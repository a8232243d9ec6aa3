"""Command line: build a corpus from a fixture or a registry, and verify what was written.

    python -m lodewright.cli build --fixture rows.jsonl --registry registry.json --refs refs --out audit [--freeze]
    python -m lodewright.cli build --root staged --registry registry.json --refs refs --out audit
    python -m lodewright.cli verify audit
    python -m lodewright.cli study out
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright import run as run_record
from lodewright.config import DEFAULT, DOCUMENT
from lodewright.operators import ingest
from lodewright.operators.license import backfill_tokens
from lodewright.plans import pipeline
from lodewright.session import local_session, ship
from lodewright.sources import readers, sinks
from lodewright.tokenizer import corpus, study


def fixture_documents(spark: SparkSession, path: str, registry: dict, date: str) -> DataFrame:
    """Documents of fixture rows, each row with the registry entry of its source (rows of other sources are an error)."""
    rows = readers.read_fixture(spark, path)
    entries = {s["source_id"]: s for s in registry["sources"]}
    out = spark.createDataFrame([], DOCUMENT)
    for sid in sorted(r[0] for r in rows.select("source_id").distinct().collect()):
        mine = ingest.extract(rows.where(F.col("source_id") == sid).drop("source_id"), sid)
        ident = F.format_string("%s:%04d", F.lit(sid), F.col("row"))
        docs, _ = ingest.make_documents(mine.withColumn("doc_id", ident).withColumn("ord", F.col("row")), _plain(entries[sid]), date)
        out = out.unionByName(docs)
    return out


def _plain(source: dict) -> dict:
    return {"license": source.get("claimed_license"), "url": source.get("claimed_url"), "provenance": source.get("claimed_origin"), **source}


def reference_table(spark: SparkSession, directory: str | None) -> tuple[DataFrame, list[str]]:
    """References in order: the non-empty evaluation texts, then the files of the folder."""
    own = [(f"{corpus.CORPUS_VERSION}:{n}", k, t) for k, (n, t) in enumerate(corpus.EVALUATION.items()) if t]
    refs = spark.createDataFrame(own, "ref_id string, ref_ord bigint, text string")
    more, missing = readers.read_references(spark, directory, first_ord=len(corpus.EVALUATION)) if directory else (None, list(readers.REFERENCE_FILES))
    return (refs.unionByName(more) if more is not None else refs), missing


def build(args: argparse.Namespace) -> dict:
    spark = local_session()
    ship(spark)
    registry = readers.load_registry(args.registry)
    inventory = readers.registry_table(spark, registry)
    errors: dict[str, str] = {}
    if args.fixture:
        docs = fixture_documents(spark, args.fixture, registry, args.date)
    else:
        docs = spark.createDataFrame([], DOCUMENT)
        admitted = {r[0] for r in inventory.where("status = 'admitted'").select("source_id").collect()}
        for source in registry["sources"]:
            if source["source_id"] in admitted:
                got, _, error = readers.collect_documents(spark, _plain(source), args.root, args.date, cap=DEFAULT.problem_cap, max_docs=args.max_docs)
                if error:
                    errors[source["source_id"]] = error
                else:
                    docs = docs.unionByName(got)
    refs, missing = reference_table(spark, args.refs)
    vocabulary = study.frozen_vocabulary()
    result = pipeline.with_ceiling(pipeline.run(docs, refs, vocabulary))
    inventory = backfill_tokens(inventory.withColumn("status", F.when(F.col("source_id").isin(*errors), "blocked").otherwise(F.col("status"))) if errors else inventory, result.docs)
    report = pipeline.metrics_report(result, inventory, registry)
    report |= {"tokenizer_fingerprint": vocabulary.fingerprint, "environment": run_record.environment(spark, args.seed, args.revision), "fetch_errors": errors}
    contamination = {"n_refs": refs.count(), "benchmark_refs_missing": missing, **report["contamination_hits"]}
    sinks.write_audit(args.out, inventory=inventory, removed=result.removed, contamination=contamination, hits=result.hits, metrics=report, mixture=report["mixture"], freeze=args.freeze)
    sinks.write_jsonl(pipeline.metrics.solutions_per_problem(result.start, result.kept), str(Path(args.out) / "solutions_per_problem"))
    run_record.write_identity(args.out, {d: n for d, n in report["mixture"]["actual"].items() if d != "total"}, vocabulary.fingerprint, args.seed)
    return {"docs": sum(x["n_docs"] for x in pipeline.metrics.tokens_per_source(result.kept).collect()), "stages": report["stages"], "packing": report["packing"]}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodewright")
    sub = parser.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    for name, default in (("--fixture", None), ("--root", "."), ("--registry", None), ("--refs", None), ("--out", "audit"), ("--date", "2026-01-01")):
        b.add_argument(name, default=default, required=name == "--registry")
    b.add_argument("--max-docs", type=int)
    b.add_argument("--seed", type=int, default=DEFAULT.seed)
    b.add_argument("--revision", help="name of the code version, for the run record")
    b.add_argument("--freeze", action="store_true")
    sub.add_parser("verify").add_argument("directory")
    sub.add_parser("study").add_argument("directory")
    args = parser.parse_args(argv)
    if args.command == "build":
        print(json.dumps(build(args), indent=2, sort_keys=True))
        return 0
    if args.command == "verify":
        problems = sinks.validate_audit(args.directory) + run_record.check_identity(args.directory)
        print("\n".join(problems) or "ok")
        return bool(problems)
    reports, winner = study.study(local_session())
    study.freeze(args.directory, winner, reports)
    print(winner.fingerprint)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
