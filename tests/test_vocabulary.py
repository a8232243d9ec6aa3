import json

import pytest

from lodewright.sources import readers, sinks
from lodewright.tokenizer import corpus, metrics, study, train
from lodewright.tokenizer.model import BOS_ID, EOS_ID, Vocabulary


def test_frozen_fingerprint_and_counts():
    v = study.frozen_vocabulary()
    assert (len(v.merges), v.metadata["n_unused"], v.size) == (952, 31478, 32768)


@pytest.mark.parametrize("text", [*corpus.FALLBACK, *corpus.EVALUATION.values()])
def test_round_trip(text):
    v = study.frozen_vocabulary()
    assert v.decode(v.encode(text)) == text


def test_marks_and_errors():
    v = study.frozen_vocabulary()
    ids = v.encode("<bos>", bos=True, eos=True)
    assert ids[0] == BOS_ID and ids[-1] == EOS_ID and BOS_ID not in ids[1:-1]
    assert v.decode(ids) == "<bos>" and v.decode(ids, skip_special_tokens=False) == "<bos><bos><eos>"
    with pytest.raises(ValueError):
        v.decode([40000])
    with pytest.raises(TypeError):
        v.encode(b"x")


def test_greedy_longest_match():
    v = study.frozen_vocabulary()
    tokens = v._usable()
    text = "def compute_1_value(x_1: float) -> float:\n    return y ** 2\n"
    s, at, want = text.encode().decode("latin-1"), 0, []
    while at < len(s):
        n = max(k for k in range(1, 40) if s[at : at + k] in tokens and at + k <= len(s))
        want.append(tokens[s[at : at + n]])
        at += n
    assert v.encode(text) == want


def test_lines_and_pairs_match_plain_counts(spark):
    from collections import Counter

    texts = ["a\nb\r\nc\rd", "a\n\x0bx ", "", "a\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter(x for t in texts for x in t.splitlines(keepends=True))
    assert {r.line: r.n for r in train.line_counts(df).collect()} == want
    pairs = Counter()
    for line, n in want.items():
        b = line.encode()
        for x, y in zip(b, b[1:]):
            pairs[x + 4, y + 4] += n
    assert {(r.left, r.right): r.n for r in train.pair_counts(train.line_counts(df)).collect()} == pairs


def test_incremental_merges_equal_full_recounts():
    from collections import Counter

    lines = Counter({tuple(b"abcabcab"): 3, tuple(b"aaaa"): 2, tuple(b"cabca"): 1})
    seqs, want = {k: n for k, n in lines.items()}, []
    for step in range(6):
        c = Counter()
        for k, n in seqs.items():
            for p in zip(k, k[1:]):
                c[p] += n
        if not c or max(c.values()) < 2:
            break
        p = min(c, key=lambda q: (-c[q], q))
        want.append([*p, 300 + step])
        new = Counter()
        for k, n in seqs.items():
            new[tuple(train.apply_merge(list(k), *p, 300 + step))] += n
        seqs = new
    assert train.learn_merges(lines, 6, 300) == want


def test_metrics_of_the_frozen_vocabulary(spark):
    m = metrics.report(spark, study.frozen_vocabulary()).first().asDict()
    assert not metrics.failures(m)
    assert [round(m[k], 3) for k in ("tokens_per_python_line", "tokens_per_function", "compression_ratio", "identifier_fragmentation", "import_fragmentation")] == [7.814, 19.5, 2.896, 1.535, 6.286]


def test_study_and_freeze(spark, tmp_path):
    reports, winner = study.study(spark, extra_lines=30)
    assert reports[0]["passed"]
    study.freeze(tmp_path / "t", winner, reports, 30)
    t = study.FrozenTokenizer.load(tmp_path / "t")
    assert t.decode(t.encode("x = 1\n")) == "x = 1\n" and t.config["fingerprint"] == winner.fingerprint
    with pytest.raises(FileExistsError):
        study.freeze(tmp_path / "t", winner, reports, 30)
    data = json.loads((tmp_path / "t" / "tokenizer.json").read_text())
    data["merges"] = data["merges"][:-1]
    (tmp_path / "t" / "tokenizer.json").write_text(json.dumps(data))
    assert sinks.verify_sums(tmp_path / "t") == ["tokenizer.json"]
    with pytest.raises(ValueError):
        Vocabulary.from_json(data)


def test_readers(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"source_id": "a", "text": "one"}\n\n{"source_id": "b", "text": "two", "score": 3.5}\n')
    rows = readers.read_fixture(spark, str(p)).orderBy("row").collect()
    assert [(r.row, r.source_id, r.score) for r in rows] == [(0, "a", None), (1, "b", 3.5)]
    df, err = readers.read_source(spark, {"files": ["x.jsonl"]}, str(tmp_path))
    assert err is None and df.count() == 2
    assert readers.read_source(spark, {"files": ["missing.parquet"]}, str(tmp_path))[1]
    assert readers.read_source(spark, {"files": []}, str(tmp_path))[1]
    (tmp_path / "mbpp.txt").write_text("reference text")
    refs, missing = readers.read_references(spark, str(tmp_path))
    assert missing == ["humaneval.txt"] and refs.first().text == "reference text"
    docs, removed, err = readers.collect_documents(spark, {"source_id": "web", "identity_status": "verified", "files": ["x.jsonl"], "domain": "stem"}, str(tmp_path), "2031-01-01", max_docs=1)
    assert err is None and [r.doc_id for r in docs.collect()] == ["web:000000:00"]
    assert readers.collect_documents(spark, {"source_id": "w", "decision": "reject"}, str(tmp_path), "x")[2]


def test_audit_bundle(spark, tmp_path):
    inv = spark.createDataFrame([("a", 1)], "source_id string, token_count int")
    rem = spark.createDataFrame([("s", "a", "d", ["x"])], "stage string, source_id string, doc_id string, reason_codes array<string>")
    mix = {"actual": {"python": 1, "math": 2, "total": 3}}
    sinks.write_audit(tmp_path / "m", inventory=inv, removed=rem, contamination={}, hits=rem, metrics={}, mixture=mix, freeze=True)
    assert sinks.validate_audit(tmp_path / "m") == []
    with pytest.raises(FileExistsError):
        sinks.write_audit(tmp_path / "m", inventory=inv, removed=rem, contamination={}, hits=rem, metrics={}, mixture=mix)
    table = sinks.sums_table(spark.read.format("binaryFile").load(str(tmp_path / "m" / "data_manifest.jsonl")))
    assert table.first().sha256 == sinks.sha256_file(tmp_path / "m" / "data_manifest.jsonl")


def test_merge_by_rank_follows_the_priorities():
    assert train.merge_by_rank([1, 2, 3, 1, 2], [[2, 3, 10], [1, 2, 11]]) == [1, 10, 11]
    assert train.merge_by_rank([5], []) == [5] and train.merge_by_rank([], []) == []


def test_seed_pieces_keep_the_bytes():
    text = "def f(): return self.x".encode()
    assert train.seeded_bytes(text, train.code_pieces()) == train.seeded_bytes(text, []) == [b + 4 for b in text]
    assert (len(train.CODE_KEYWORDS), len(train.CODE_OPERATORS), len(train.CODE_EXTRAS)) == (35, 21, 22)


def test_corpus_bundle():
    b = corpus.bundle(10)
    assert len(b["training"]) == len(corpus.EVALUATION) + 10 and b["evaluation_hash"] != b["training_hash"] == corpus.corpus_hash(corpus.training(10))


def test_reference_text_and_other_formats(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 5)], "n int, x string, y int")
    assert readers.reference_text(df, ["x", "y"], "n").first().text == "a\n5\n\nb"
    df.write.orc(str(tmp_path / "t.orc"))
    rows, error = readers.read_source(spark, {"files": ["t.orc"], "format": "orc"}, str(tmp_path))
    assert error is None and rows.count() == 2
    assert readers.read_source(spark, {"files": ["t.orc"]}, str(tmp_path))[1]
