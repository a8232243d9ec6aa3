"""Sinks: JSONL, JSON, checksums, the audit bundle, freezing, corpus identity."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUDIT_FILES = ("data_manifest.jsonl", "dedup_manifest.jsonl", "contamination_report.json", "data_pipeline_metrics.json", "mixture_summary.json")
NOT_WRITTEN = ("text", "token_ids")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Distributed JSON lines, keys sorted, without texts and ids."""
    df.select(*sorted(c for c in df.columns if c not in NOT_WRITTEN)).write.mode("overwrite").json(path)


def write_jsonl_file(df: DataFrame, path: str | Path, order: list[str] | None = None) -> Path:
    """One JSONL file with sorted keys, streamed row by row through the driver (for manifests)."""
    cols = sorted(c for c in df.columns if c not in NOT_WRITTEN)
    rows = df.select(*cols)
    rows = rows.orderBy(*order) if order else rows
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("w", encoding="utf-8") as f:
        for r in rows.toLocalIterator(prefetchPartitions=True):
            f.write(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) + "\n")
    return p


def write_json(path: str | Path, payload: object) -> Path:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")
    return p


def write_contamination(path: str | Path, head: dict, hits: DataFrame) -> Path:
    """The contamination report: ``head`` and the list of hits, which is streamed through the driver and never held there."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("w", encoding="utf-8") as f:
        f.write("".join(f"{'{' if not k else ', '}{json.dumps(n)}: {json.dumps(head[n], default=str)}" for k, n in enumerate(sorted(head))) + (', "hits": [' if head else '{"hits": ['))
        for k, r in enumerate(hits.orderBy("doc_id").toLocalIterator(prefetchPartitions=True)):
            f.write((",\n" if k else "\n") + json.dumps(r.asDict(recursive=True), sort_keys=True, default=str))
        f.write("\n]}\n")
    return p


def sha256_file(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def write_sums(directory: str | Path, names: list[str] | None = None) -> Path:
    """``SHA256SUMS`` over the files of a folder (or ``names``)."""
    root = Path(directory)
    names = names or sorted(p.name for p in root.iterdir() if p.is_file() and p.name not in ("SHA256SUMS", "FROZEN.json"))
    (root / "SHA256SUMS").write_text("".join(f"{sha256_file(root / n)}  {n}\n" for n in names), encoding="utf-8")
    return root / "SHA256SUMS"


def verify_sums(directory: str | Path) -> list[str]:
    """Names of files that are missing or differ from ``SHA256SUMS``."""
    root = Path(directory)
    bad = []
    for line in (root / "SHA256SUMS").read_text(encoding="utf-8").splitlines():
        digest, _, name = line.partition("  ")
        if not (root / name).is_file() or sha256_file(root / name) != digest:
            bad.append(name)
    return bad


def sums_table(df: DataFrame) -> DataFrame:
    """``path, sha256`` of a ``binaryFile`` table, hashed on the executors."""
    return df.select("path", F.sha2("content", 256).alias("sha256"))


def corpus_identity(directory: str | Path) -> str:
    """sha256 over ``digest  name`` lines of the audit files, in fixed order."""
    root = Path(directory)
    return hashlib.sha256("".join(f"{sha256_file(root / n)}  {n}\n" for n in AUDIT_FILES).encode()).hexdigest()


def write_audit(directory: str | Path, *, inventory: DataFrame, removed: DataFrame, contamination: dict, hits: DataFrame, metrics: dict, mixture: dict, freeze: bool = False) -> Path:
    """The audit bundle with its sums. A frozen folder is refused before anything is written."""
    root = Path(directory)
    if (root / "FROZEN_PRETRAIN.json").exists():
        raise FileExistsError(f"{root} is frozen")
    write_jsonl_file(inventory, root / AUDIT_FILES[0], ["source_id"])
    write_jsonl_file(removed, root / AUDIT_FILES[1], ["stage", "source_id", "doc_id"])
    write_contamination(root / AUDIT_FILES[2], contamination, hits)
    for name, payload in zip(AUDIT_FILES[3:], (metrics, mixture)):
        write_json(root / name, payload)
    write_sums(root, list(AUDIT_FILES))
    if freeze:
        write_json(root / "FROZEN_PRETRAIN.json", {"corpus_hash": corpus_identity(root), "files": list(AUDIT_FILES)})
    return root


def validate_audit(directory: str | Path) -> list[str]:
    """Problems of an audit folder: sums that differ, mixture totals that do not add up."""
    root = Path(directory)
    found = [f"{n} differs" for n in verify_sums(root)]
    actual = json.loads((root / AUDIT_FILES[4]).read_text()).get("actual") or {}
    if actual and actual.get("total") != sum(v for k, v in actual.items() if k != "total"):
        found.append("mixture total is not the sum of its domains")
    return found


def manifest_shards(inventory: DataFrame) -> DataFrame:
    """Shard descriptors of a manifest: source, domain, tokens (null as 0), status."""
    return inventory.select("source_id", "domain", F.coalesce("token_count", F.lit(0)).alias("token_count"), "status")


