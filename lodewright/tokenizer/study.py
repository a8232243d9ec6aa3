"""Candidate study: train all candidates, gate and rank them, prove the winner reproducible, freeze it; and the load-only frozen form."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from lodewright.sources.sinks import verify_sums, write_json, write_sums
from lodewright.tokenizer import corpus, metrics
from lodewright.tokenizer.model import BOS_ID, EOS_ID, PAD_ID, Vocabulary
from lodewright.tokenizer.train import train

CANDIDATES = ("byte_bpe", "byte_bpe_code", "unicode_bpe_bytes")
FROZEN_FINGERPRINT = "219156db6bbe8c573c0f1654ab9f622c0e8bd51519561ac30d2c13fbf3a01a6e"  # fixed value: the frozen vocabulary
FROZEN_LINES = 400

_frozen: dict[str, Vocabulary] = {}


def frozen_vocabulary() -> Vocabulary:
    """The frozen vocabulary, trained anew (seconds) and checked against its fingerprint."""
    if "v" not in _frozen:
        v = train(corpus.training(FROZEN_LINES))
        if v.fingerprint != FROZEN_FINGERPRINT:
            raise ValueError("the trained vocabulary is not the frozen one")
        _frozen["v"] = v
    return _frozen["v"]


def study(spark: SparkSession, extra_lines: int = FROZEN_LINES, size: int = 32_768) -> tuple[list[dict], Vocabulary]:
    """Reports of all candidates in order of rank, and the winner."""
    texts = corpus.training(extra_lines)
    found = []
    for name in CANDIDATES:
        v = train(texts, name, size)
        m = metrics.report(spark, v).first().asDict()
        bad = metrics.failures(m)
        found.append({"name": name, "metrics": m, "failures": bad, "passed": not bad, "fingerprint": v.fingerprint, **{k: v.metadata[k] for k in ("n_merges", "n_unused")}, "vocabulary": v})
    found.sort(key=lambda r: (not r["passed"], *metrics.ranking(r["metrics"], r["name"])))
    if not found or not found[0]["passed"]:
        raise ValueError("no candidate passes all gates")
    winner = found[0].pop("vocabulary")
    if train(texts, found[0]["name"], size).fingerprint != winner.fingerprint:
        raise ValueError("training the winner again gives another vocabulary")
    return [{k: x for k, x in r.items() if k != "vocabulary"} for r in found], winner


def freeze(directory: str | Path, vocabulary: Vocabulary, reports: list[dict], extra_lines: int = FROZEN_LINES) -> Path:
    """Write vocabulary, reports, sums and the freeze mark; a frozen folder is not written again."""
    root = Path(directory)
    if (root / "FROZEN.json").exists():
        raise FileExistsError(f"{root} is frozen")
    root.mkdir(parents=True, exist_ok=True)
    vocabulary.save(root / "tokenizer.json")
    for r in reports:
        write_json(root / f"candidate_{r['name']}.json", r)
    write_sums(root)
    fixed = corpus.bundle(extra_lines)
    mark = {"fingerprint": vocabulary.fingerprint, "extra_lines": extra_lines, "evaluation_hash": fixed["evaluation_hash"], "training_hash": fixed["training_hash"]}
    return write_json(root / "FROZEN.json", mark)


class FrozenTokenizer:
    """Load-only use of a frozen folder."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._v = vocabulary

    @classmethod
    def load(cls, directory: str | Path) -> FrozenTokenizer:
        """Needs the freeze mark, matching sums and a matching fingerprint."""
        root = Path(directory)
        if not (root / "FROZEN.json").exists():
            raise FileNotFoundError(f"{root} is not frozen")
        if bad := verify_sums(root):
            raise ValueError(f"files differ from their sums: {bad}")
        return cls(Vocabulary.load(root / "tokenizer.json", json.loads((root / "FROZEN.json").read_text())["fingerprint"]))

    def encode(self, text: str, *, add_bos: bool = False, add_eos: bool = False) -> list[int]:
        return self._v.encode(text, bos=add_bos, eos=add_eos)

    def decode(self, ids: list[int], *, skip_special_tokens: bool = True) -> str:
        return self._v.decode(ids, skip_special_tokens=skip_special_tokens)

    @property
    def config(self) -> dict:
        return {"vocab_size": self._v.size, "algorithm": self._v.algorithm, "fingerprint": self._v.fingerprint, "pad_id": PAD_ID, "bos_id": BOS_ID, "eos_id": EOS_ID}
