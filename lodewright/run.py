"""Run records: what a run needs to be repeated, its configuration, and the identity of an audited corpus."""

from __future__ import annotations

import json
import random
from pathlib import Path

from pyspark.sql import SparkSession

from lodewright.sources.sinks import AUDIT_FILES, corpus_identity, verify_sums, write_json

# What a configuration must hold: path of the value, its type (bool is no integer), whether it may be empty.
CONFIG_RULES: tuple[tuple[str, type, bool], ...] = (("project", str, False), ("python.requires", str, True), ("reproducibility.seed", int, True), ("config.identity", object, True))


def environment(spark: SparkSession, seed: int, revision: str | None = None) -> dict:
    """The run's record, from the session itself: versions, plan settings, application.

    Operators take seeds as parameters and hash rows, so no random state of a process matters. ``revision`` names
    the code, given by whoever builds it. Syntax tests depend on the workers' Python, so it is part of the record.
    """
    sc = spark.sparkContext
    plan = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone", "spark.sql.ansi.enabled")}
    return {"seed": seed, "revision": revision, "spark": spark.version, "python": sc.pythonVer, "application": sc.applicationId, "started_ms": sc.startTime, "master": sc.master, "parallelism": sc.defaultParallelism, "plan": plan}


def generator(seed: int) -> random.Random:
    """Random numbers of the driver, from a seed that must be an integer; there is no global state to set."""
    if not isinstance(seed, int) or isinstance(seed, bool):
        raise TypeError(f"the seed must be an integer, not {type(seed).__name__}")
    return random.Random(seed)


def check_config(config: dict) -> list[str]:
    """Problems of a run configuration by ``CONFIG_RULES``, and a claim to be frozen; empty if it is usable."""
    found = []
    for path, kind, empty in CONFIG_RULES:
        value: object = config
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is None:
            found.append(f"missing {path}")
        elif not isinstance(value, kind) or (kind is int and isinstance(value, bool)) or (not empty and not str(value).strip()):
            found.append(f"{path} is no usable {kind.__name__}")
    if isinstance(config.get("config"), dict) and config["config"].get("frozen") is True:
        found.append("config.frozen must not be set before a run")
    return found


def load_config(path: str, *, check: bool = True) -> dict:
    """A configuration file (JSON, or YAML where its parser is installed); with ``check`` it must be usable."""
    from lodewright.sources.readers import load_mapping

    config = load_mapping(path)
    if check and (problems := check_config(config)):
        raise ValueError(f"{path}: {'; '.join(problems)}")
    return config


def check_prerequisites(directory: str | Path, fingerprint: str, total: int | None = None) -> dict:
    """The identity of an audited corpus that training may start from; it must be of that vocabulary and size, unchanged and not frozen."""
    root = Path(directory)
    problems = check_identity(root)
    body = json.loads((root / "IDENTITY.json").read_text(encoding="utf-8"))
    if body["tokenizer_fingerprint"] != fingerprint:
        problems.append("the vocabulary is another one")
    if total is not None and body["total"] != total:
        problems.append("the number of tokens is another one")
    if (root / "FROZEN_PRETRAIN.json").exists():
        problems.append("the corpus is frozen")
    if problems:
        raise ValueError("; ".join(problems))
    return body


def write_identity(directory: str | Path, tokens: dict[str, int], fingerprint: str, seed: int) -> Path:
    """Record token counts, vocabulary and hash of an audited corpus beside its files."""
    body = {"tokens": tokens, "total": sum(tokens.values()), "tokenizer_fingerprint": fingerprint, "seed": seed, "corpus_hash": corpus_identity(directory)}
    return write_json(Path(directory) / "IDENTITY.json", body)


def check_identity(directory: str | Path) -> list[str]:
    """Differences between the record, the audit files, their sums and the mixture."""
    root = Path(directory)
    body = json.loads((root / "IDENTITY.json").read_text(encoding="utf-8"))
    found = [f"{n} differs" for n in verify_sums(root)]
    if body["corpus_hash"] != corpus_identity(root):
        found.append("corpus hash differs")
    actual = json.loads((root / AUDIT_FILES[4]).read_text(encoding="utf-8")).get("actual", {})
    found += [f"tokens of {d} differ" for d, n in body["tokens"].items() if actual.get(d) != n]
    if body["total"] != actual.get("total"):
        found.append("total differs")
    return found
