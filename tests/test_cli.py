"""The whole build on a planted fixture: every kind of removal occurs, a second run gives the same files."""

import json

import pytest

from lodewright import cli, run
from lodewright.operators import packing
from lodewright.sources import sinks
from lodewright.tokenizer.corpus import EVALUATION

ADD = "def add(a, b):\n    total = a + b\n    return total\n\nprint(add(1, 2))\n"


def fixture_rows():
    py = lambda text, **k: {"source_id": "tiny_python", "text": text, **k}
    contest = lambda i, **k: {"source_id": "codecontests_plus", "text": f"# solve p1 variant\nn = int(input())\nprint(n * {i} + {i * i})\n", "problem_id": "p1", "is_correct": True, "language_tag": "python3"} | k
    rows = [py(ADD), py(ADD), py(ADD.replace("total", "result")), py("def broken(:\n    return 1  # unbalanced text here\n"), py(EVALUATION["python/imports"])]
    rows += [contest(i) for i in range(9)] + [contest(20, is_correct=False), contest(21, language_tag="cpp")]
    rows += [{"source_id": "openmathinstruct_2", "problem": "What is 1 + 1, as anyone may ask?", "generated_solution": s} for s in ("2", "We add both numbers and therefore get 2.")]
    stem = "The theorem follows from the proof by search over a tree of all numerical cases, so the algorithm ends. "
    rows += [{"source_id": "web", "text": stem * 2, "score": 3.5}, {"source_id": "web", "text": "Some prose without any hint, long enough to pass the rules.", "score": 3.0}, {"source_id": "web", "text": "Another proof by greedy search, of too low a score to be kept by the rules.", "score": 1.0}]
    return rows


def registry():
    ok = {"identity_status": "verified", "claimed_license": "mit"}
    return {
        "math_raw_estimate_tokens": 5, "math_plan_target_tokens": 3,
        "sources": [{"source_id": "tiny_python", "domain": "python", **ok}, {"source_id": "codecontests_plus", "domain": "python", **ok}, {"source_id": "openmathinstruct_2", "domain": "math", **ok}, {"source_id": "web", "domain": "stem", **ok},
                    {"source_id": "closed", "domain": "stem", "identity_status": "verified", "claimed_license": None}],
    }


def test_build_and_verify(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text("\n".join(json.dumps(r) for r in fixture_rows()))
    (tmp_path / "registry.json").write_text(json.dumps(registry()))
    args = ["build", "--fixture", str(tmp_path / "rows.jsonl"), "--registry", str(tmp_path / "registry.json")]
    assert cli.main([*args, "--out", str(tmp_path / "a"), "--freeze"]) == 0
    removed = [json.loads(x) for x in (tmp_path / "a" / "dedup_manifest.jsonl").read_text().splitlines()]
    codes = {(r["stage"], c) for r in removed for c in r["reason_codes"]}
    assert codes >= {
        ("ingest", "incorrect_solution"), ("ingest", "not_python"), ("problem_cap", "problem_cap"), ("exact_dedup", "exact_duplicate"), ("quality", "syntax_invalid"), ("quality", "openmath_trivial"), ("quality", "low_edu_score"),
        ("contamination", "contaminated"), ("highsignal", "stem_not_reasoning_dense"),
    }
    m = json.loads((tmp_path / "a" / "data_pipeline_metrics.json").read_text())
    assert m["mixture"]["math_raw_estimate_vs_plan"]["gap"] == 2 and m["blocked_sources"] == ["closed"] and m["packing"]["n_sequences"] >= 1
    assert cli.main(["verify", str(tmp_path / "a")]) == 0
    report = json.loads((tmp_path / "a" / "contamination_report.json").read_text())
    assert report["n_hits"] == len(report["hits"]) > 0
    assert any((tmp_path / "a" / "solutions_per_problem").glob("*.json"))
    body = json.loads((tmp_path / "a" / "IDENTITY.json").read_text())
    with pytest.raises(ValueError, match="frozen"):
        run.check_prerequisites(tmp_path / "a", body["tokenizer_fingerprint"])
    with pytest.raises(FileExistsError):
        cli.main([*args, "--out", str(tmp_path / "a")])
    assert cli.main([*args, "--out", str(tmp_path / "b")]) == 0
    for name in ("data_manifest.jsonl", "dedup_manifest.jsonl", "contamination_report.json", "mixture_summary.json"):
        assert sinks.sha256_file(tmp_path / "a" / name) == sinks.sha256_file(tmp_path / "b" / name)
    assert run.check_prerequisites(tmp_path / "b", body["tokenizer_fingerprint"], body["total"]) == body
    with pytest.raises(ValueError, match="vocabulary"):
        run.check_prerequisites(tmp_path / "b", "other")
    (tmp_path / "b" / "mixture_summary.json").write_text('{"actual": {"python": 1, "math": 0, "stem": 0, "total": 2}}')
    assert cli.main(["verify", str(tmp_path / "b")]) == 1


def test_run_records(spark, tmp_path):
    assert run.generator(7).random() == run.generator(7).random()
    for bad in ("7", True):
        with pytest.raises(TypeError):
            run.generator(bad)
    record = run.environment(spark, 7, "abc")
    assert (record["seed"], record["revision"], record["spark"]) == (7, "abc", spark.version) and record["plan"]["spark.sql.session.timeZone"] == "UTC"
    good = {"project": "x", "python": {"requires": ">=3.10"}, "reproducibility": {"seed": 1}, "config": {"identity": "a"}}
    assert run.check_config(good) == []
    bad = {"project": " ", "python": {}, "reproducibility": {"seed": "1"}}
    assert run.check_config(bad) == ["project is no usable str", "missing python.requires", "reproducibility.seed is no usable int", "missing config.identity"]
    assert run.check_config(good | {"config": {"identity": "a", "frozen": True}}) == ["config.frozen must not be set before a run"]
    (tmp_path / "c.json").write_text(json.dumps(good))
    assert run.load_config(str(tmp_path / "c.json")) == good
    (tmp_path / "c.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError):
        run.load_config(str(tmp_path / "c.json"))
    assert run.load_config(str(tmp_path / "c.json"), check=False) == bad


def test_batches_and_losses(spark):
    seq = spark.createDataFrame([(0, [5, 3, 0]), (1, [6, 3, 0])], "seq_id bigint, token_ids array<int>")
    assert packing.make_batch(seq, 3) == [[5, 3, 0], [6, 3, 0], [5, 3, 0]]
    with pytest.raises(ValueError):
        packing.make_batch(seq, 1, vocab_size=4)
    with pytest.raises(ValueError):
        packing.make_batch(seq.limit(0), 1)
    loss = spark.createDataFrame([(1.0, 1), (4.0, 3)], "loss double, non_pad_tokens int")
    assert tuple(packing.weighted_loss(loss).first()) == (3.25, 4)
