"""Operators on small planted inputs, against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.config import DEFAULT, DOCUMENT
from lodewright.functions import hashing
from lodewright.functions import text as tx
from lodewright.functions.hashing import estimated_jaccard, fingerprint, minhash, minhash_values, normalized_hash
from lodewright.operators import base, contamination, dedup, ingest, license, metrics, mixture, packing, quality
from lodewright.operators.packing import apply_table, block_table
from lodewright.plans.queries import QUERIES

DOC = {f.name: None for f in DOCUMENT.fields}


def docs(spark, rows):
    full = [DOC | {"ord": i, "doc_id": f"d{i:03}", "source_id": "s", "domain": "stem"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in DOCUMENT.fields) for r in full], DOCUMENT)


def test_hash_is_that_of_the_wrapped_text(spark):
    import hashlib

    want = hashlib.sha256(json.dumps({"normalized_utf8_text": "é x"}, sort_keys=True).encode()).hexdigest()
    assert spark.createDataFrame([("é x",), (None,)], "t string").select(normalized_hash(F.col("t"))).collect() == [(want,), (None,)]


@pytest.mark.parametrize("text,binary", [("", False), ("plain text\n", False), ("a\0b", True), ("\x01\x02\x03ab", True), ("a b", False)])
def test_binary(spark, text, binary):
    assert spark.createDataFrame([(text,)], "t string").select(tx.is_binary(F.col("t"))).first()[0] is binary


def test_words_split_like_python(spark):
    for t in ("a\x1cb\x85c\xa0d  e", "", "  x ", "one two\tthree"):
        assert spark.createDataFrame([(t,)], "t string").select(tx.words(F.col("t"))).first()[0] == t.split()


def test_exact_dedup_keeps_the_first_and_names_it(spark):
    kept, removed = dedup.exact_dedup(docs(spark, [{"normalized_hash": h} for h in ("a", "b", "a", None, None, "a")]))
    assert [r.doc_id for r in kept.orderBy("ord").collect()] == ["d000", "d001", "d003", "d004"]
    assert {(r.doc_id, r.duplicate_of) for r in removed.collect()} == {("d002", "d000"), ("d005", "d000")}


def test_exact_dedup_tells_rows_of_one_id_apart(spark):
    kept, removed = dedup.exact_dedup(docs(spark, [{"doc_id": "x", "normalized_hash": h} for h in ("a", "a", "b")]))
    assert [(r.doc_id, r.normalized_hash) for r in kept.orderBy("ord").collect()] == [("x", "a"), ("x", "b")] and removed.count() == 1


def test_content_hash_in_the_jvm_and_in_python_is_one(spark):
    texts = ["plain", 'quote " back \\ slash', "\n\r\t\b\f", "", "\x7f", "\x00", "\u00e9 \U0001f600", "\x1b", "a" * 5_000, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalized_hash(F.col("t"))).collect()]
    assert got == [None if t is None else fingerprint({"normalized_utf8_text": t}) for t in texts]


def test_crowded_bands_are_split_without_loss(spark):
    rng = random.Random(3)
    head = " ".join(f"template{i}" for i in range(30))
    rows = [{"text": head + " " + " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 3)}" for _ in range(12))} for _ in range(60)]
    df = docs(spark, rows)
    sigs = dedup.signatures(dedup.with_signature(df))
    whole, split = ({(r.a.doc_id, r.b.doc_id, r.band, r.similarity) for r in dedup.near_edges(None, sigs=sigs, hot=n).collect()} for n in (10**9, 5))
    assert whole and split == whole


def test_rounds_of_near_dedup_equal_one_task(spark, monkeypatch):
    rng = random.Random(8)
    words = " ".join(f"word{i}" for i in range(60)).split()
    rows = []
    for i in range(40):
        t = words[:]
        for _ in range(i % 7):
            t[rng.randrange(60)] = f"new{rng.randint(0, 99)}"
        rows.append({"text": " ".join(t)})
    sigs = dedup.with_signature(docs(spark, rows))
    at_once = {tuple(r) for r in dedup.near_removed(sigs).collect()}
    monkeypatch.setattr(dedup, "SETTLED_AT_ONCE", 0)
    assert at_once and {tuple(r) for r in dedup.near_removed(sigs).collect()} == at_once


def many_documents(spark, tiny, folder):
    """The smallest documents ten times, each time with other words at their end."""
    d = spark.read.parquet(f"{tiny}/documents.parquet")
    tens = d.crossJoin(spark.range(10).toDF("turn"))
    text = F.concat("text", *[F.concat(F.lit(" "), F.substring(F.md5(F.concat("turn", F.lit(f":{i}:"), "doc_id")), 1, 6)) for i in range(40)])
    tens.withColumn("text", text).withColumn("doc_id", F.col("doc_id") + F.col("turn") * 1_000_000).drop("turn").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet").count()


@pytest.mark.parametrize("name", ["near_dedup", "near_edges"])
def test_near_queries_write_little_more_than_a_signature_a_document(spark, tiny, tmp_path, name):
    n = many_documents(spark, tiny, tmp_path)
    spark.sparkContext.setCheckpointDir(str(tmp_path / "kept"))
    assert QUERIES[name](spark, str(tmp_path)).count() > 0
    assert sum(p.stat().st_size for p in (tmp_path / "kept").rglob("part-*")) < 2_500 * n


def template_rows(n, seed):
    """Documents of one long head and of few, changed tails; some are copies or have no hash."""
    rng = random.Random(seed)
    head = [f"template{i}" for i in range(30)]
    rows = [" ".join(head + [f"{rng.choice('abcdef')}{rng.randint(0, 3)}" for _ in range(rng.choice([6, 12, 40]))]) for _ in range(n)]
    texts = rows + rows[:5] + ["", "", "abc", "x\u4e00y" * 9, "x\u4e00y" * 10]
    return [{"text": t, "source_id": rng.choice(["r", "s", None]), "normalized_hash": None if i % 9 == 0 else hashlib.sha256(t.encode()).hexdigest()} for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [4, 1_000])
def test_near_edges_are_those_of_all_pairs(spark, hot):
    rows = template_rows(70, 4)
    firsts, known, seen = {}, {}, set()
    for i, r in enumerate(rows):
        if r["normalized_hash"] is None or r["normalized_hash"] not in seen:
            seen.add(r["normalized_hash"])
            sig = minhash_values(r["text"], DEFAULT.permutations, DEFAULT.shingle)
            k = (r["source_id"] or "", f"d{i:03}")
            firsts[sig.tobytes()] = min(k, firsts.get(sig.tobytes(), k))
            known[k] = sig
    own = sorted(firsts.values())
    want = {(a[1], b[1], float((known[a] == known[b]).mean())) for i, a in enumerate(own) for b in own[:i] if (known[a] == known[b]).mean() >= DEFAULT.near_cutoff}
    sigs = dedup.signatures(dedup.with_copies(docs(spark, rows)))
    got = [(r.a.doc_id, r.b.doc_id, r.similarity) for r in dedup.near_edges(None, sigs=sigs, hot=hot).collect()]
    assert want and len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("bits", [2, 22])
def test_signatures_are_those_of_plain_hashing(monkeypatch, bits):
    monkeypatch.setattr(hashing, "SLOT_BITS", bits)
    monkeypatch.setattr(hashing, "_MET", {})
    rng = random.Random(6)
    for n in (1, 4, 5, 70):
        add, mul = hashing._family(128)
        for alphabet in ("ab", "a\0", "a\u00e9\u0fff", "a\u0ffe\u1000", "a\U0001f600", "a\ud800", "\uffff"):
            for size in (0, 1, 4, 5, 6, 700):
                text = "".join(rng.choice(alphabet) for _ in range(size))
                base = [int.from_bytes(hashlib.sha256(g.encode("utf-8", "surrogatepass")).digest()[:8], "little") for g in hashing.shingles(text, n)]
                want = (np.array(base, np.uint64)[:, None] * mul + add).min(axis=0) if base else np.zeros(128, np.uint64)
                assert (minhash_values(text, 128, n) == want).all()


def test_minhash_estimates_similarity(spark):
    a, b = "the quick brown fox jumps over the lazy dog " * 3, "the quick brown fox jumps over the lazy cat " * 3
    row = spark.createDataFrame([(a, b, "")], "a string, b string, e string").select(estimated_jaccard(minhash(F.col("a")), minhash(F.col("b"))), estimated_jaccard(minhash(F.col("a")), minhash(F.col("a"))), minhash(F.col("e"))).first()
    s, t = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (a, b))
    assert abs(row[0] - len(s & t) / len(s | t)) < 0.2
    assert row[1] == 1.0
    assert set(row[2]) == {0}


def greedy(rows, cutoff):
    kept, gone = [], {}
    sigs = {d: minhash_values(t, DEFAULT.permutations, DEFAULT.shingle) for d, _, t in rows}
    for d, s, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        hit = next((k for k in kept if (sigs[k] == sigs[d]).mean() >= cutoff), None)
        if hit is None:
            kept.append(d)
        else:
            gone[d] = hit
    return set(kept), gone


def test_near_dedup_is_greedy_in_order(spark):
    rng = random.Random(5)
    start = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "stone", "river", "cloud"]) + str(rng.randint(0, 99)) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(40):
        t = start[i % 6].split()
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"new{rng.randint(0, 999)}"
        rows.append((f"d{i:03}", f"s{i % 3}", " ".join(t)))
    rows += [(f"e{i:03}", "s1", rows[i][2]) for i in range(5)] + [("f000", "s0", ""), ("f001", "s2", "")]
    df = docs(spark, [{"doc_id": d, "source_id": s, "text": t} for d, s, t in rows])
    kept, removed = dedup.near_dedup(df)
    want, gone = greedy(rows, DEFAULT.near_cutoff)
    assert {r.doc_id for r in kept.collect()} == want
    assert {r.doc_id for r in removed.collect()} == set(gone)
    assert all(r.duplicate_of in want for r in removed.collect())


def test_problem_cap(spark):
    rows = [{"problem_id": "p", "normalized_hash": f"{9 - i}"} for i in range(9)] + [{"problem_id": ""}, {"problem_id": None}]
    kept, removed = dedup.problem_cap(docs(spark, rows), 8)
    assert kept.count() == 10
    assert [r.doc_id for r in removed.collect()] == ["d000"]


def test_quality_codes(spark):
    rows = [
        {"text": "def f(:\n    return 1  # padding padding", "domain": "python"}, {"text": "x" * 40, "quality_score": 1.0}, {"text": "short"}, {"text": "Привет мир, это длинный русский текст"},
        {"text": "import subprocess\nsubprocess.run(['ls'])\n", "domain": "python"}, {"text": "y" * 40, "is_correct": False}, {"text": "z = 1\n" * 9, "domain": "python", "language_tag": "cpp"}, {"text": None}, {"text": "fine text that is long enough to pass"},
        {"text": "1 + 1 = 2, as anyone can see at a glance", "source_id": "openmathinstruct_2", "solution": "2"},
    ]
    kept, removed = quality.apply_quality(docs(spark, rows))
    assert {r.doc_id: r.reason_codes for r in removed.collect()} == {
        "d000": ["syntax_invalid"], "d001": ["low_edu_score"], "d002": ["too_short"], "d003": ["non_english"], "d004": ["os_io_boilerplate"], "d005": ["incorrect_solution"], "d006": ["not_python"], "d007": ["too_short"], "d009": ["openmath_trivial"],
    }
    assert [r.doc_id for r in kept.collect()] == ["d008"]


def test_rubric(spark):
    rows = [
        {"domain": "python", "text": "n = int(input())\nprint(n)\n"}, {"domain": "python", "text": "How to use the library: pip install x"}, {"domain": "python", "text": "#include <iostream>"}, {"domain": "python", "text": "x = 1\n"},
        {"domain": "math", "text": "therefore", "solution": "a long enough solution text"}, {"domain": "math", "text": "t", "solution": "2"}, {"domain": "stem", "text": "a proof by search"}, {"domain": "stem", "text": "nothing here"}, {"domain": "python", "text": "with open('f') as f:\n    pass\n"},
    ]
    got = {r.doc_id: (r.highsignal_score, r.highsignal_reasons, r._accept) for r in quality.highsignal(docs(spark, rows)).collect()}
    assert got["d000"] == (4.0, ["cp_stdin_stdout_keep"], True)
    assert got["d001"][1][0] == "library_tutorial" and not got["d001"][2]
    assert got["d002"] == (0.0, ["other_language"], False)
    assert got["d003"] == (1.0, ["trivial"], False)
    assert got["d004"] == (4.0, [], True)
    assert got["d005"] == (1.0, ["math_thin"], False)
    assert got["d006"] == (4.0, [], True)
    assert got["d007"] == (1.0, ["stem_not_reasoning_dense"], False)
    assert "utility_io" in got["d008"][1] and not got["d008"][2]


def test_contamination(spark):
    ref = " ".join(f"w{i}" for i in range(30))
    refs = spark.createDataFrame([("r0", 0, ref), ("r1", 1, "tiny reference")], "ref_id string, ref_ord bigint, text string")
    rows = [{"text": "before " + " ".join(f"w{i}" for i in range(5, 17)) + " after"}, {"text": "unrelated words only here"}, {"text": "tiny reference"}, {"text": "more than a tiny reference in a longer text of more than twelve words, more than that even"}, {"text": None}, {"text": ""}]
    kept, hits = contamination.scan(docs(spark, rows), refs)
    assert {(r.doc_id, r.matched_ref) for r in hits.collect()} == {("d000", "r0"), ("d002", "r1")}
    assert kept.count() == 4 and {r.contamination_risk for r in kept.collect()} == {"clear"}


def test_contamination_by_the_filter_of_a_large_index(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(f"t{rng.randint(0, 9_999)}" for _ in range(n))
    refs = [(f"r{i}", i, text(40)) for i in range(20)]
    rows = [{"text": text(20) + " " + " ".join(refs[i][2].split()[3:20]) if i % 3 == 0 else text(50)} for i in range(20)] + [{"text": None}]
    frame = spark.createDataFrame(refs, "ref_id string, ref_ord bigint, text string")
    small = {tuple(r) for r in contamination.hits(docs(spark, rows), frame).collect()}
    monkeypatch.setattr(contamination, "MAX_BROADCAST_GRAMS", 10)
    assert len(small) == 7 and {tuple(r) for r in contamination.hits(docs(spark, rows), frame).collect()} == small


def test_license_gate(spark):
    rows = [("a", "mit", "verified", None), ("b", "mit", "verified", "reject"), ("c", None, "verified", None), ("d", "gpl", "verified", None), ("e", "mit", "unresolved", None)]
    inv = license.inventory(spark.createDataFrame(rows, "source_id string, license string, identity_status string, decision string")).collect()
    assert {r.source_id: r.status for r in inv} == {"a": "admitted", "b": "blocked", "c": "blocked", "d": "blocked", "e": "blocked"}
    assert all("missing url" in r.contract_errors for r in inv)


def test_solution_lists(spark):
    rows = [("[\"a\", \"b\"]", "u"), ("[]", "u"), (" ", "u"), ("not json", "u"), (None, "u"), ("\"one\"", "u")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row bigint, solutions string, url string")
    got = ingest.expand_solution_list(df, "taco").select("row", "item", "solution", "problem_id").orderBy("row", "item").collect()
    assert [tuple(r) for r in got] == [(0, 0, "a", "taco:u"), (0, 1, "b", "taco:u"), (3, 0, "not json", "taco:u"), (5, 0, "one", "taco:u")]


def test_parallel_arrays_stop_at_the_shorter(spark):
    df = spark.sql("SELECT 1L AS row, 'n' AS name, 'd' AS description, named_struct('language', array(3, 2, 3), 'solution', array('a', 'b')) AS solutions")
    got = ingest.expand_parallel(df).collect()
    assert [(r.solution, r.problem_id) for r in got] == [("a", "dm:n")]


def test_rows_in_memory_are_numbered_after_expansion(spark):
    source = {"source_id": "codecontests_plus", "domain": "python"}
    subs = lambda *codes: [{"language": "python3", "code": c} for c in codes]
    rows = [{"id": "p", "title": "t", "description": "d", "correct_submissions": subs("a = 1", "b = 2")}, {"id": "q", "title": "t", "description": "d", "correct_submissions": subs("c = 3")}]
    got, removed = ingest.documents_in_memory(spark, rows, source, "2026-01-01")
    assert [(r.doc_id, r.solution) for r in got.orderBy("ord").collect()] == [("codecontests_plus:00000000", "a = 1"), ("codecontests_plus:00000001", "b = 2"), ("codecontests_plus:00000002", "c = 3")]
    got, removed = ingest.documents_in_memory(spark, [{"text": "one", "score": 2.0}, {"text": "", "score": None}, {"text": "b\x00", "score": 1.0}, {"text": "two", "score": 3.0}], {"source_id": "web", "domain": "stem"}, "2026-01-01")
    assert [(r.doc_id, r.quality_score) for r in got.orderBy("ord").collect()] == [("web:00000000", 2.0), ("web:00000003", 3.0)] and [r.doc_id for r in removed.collect()] == ["web:00000002"]
    assert ingest.documents_in_memory(spark, [], {"source_id": "web", "domain": "stem"}, "2026-01-01")[0].count() == 0


def test_normalize_reasons(spark):
    df = spark.createDataFrame([("a", True), ("b\x00", True), (None, True), ("c", False), ("", True)], "t string, is_text boolean")
    assert [tuple(r[0]) for r in df.select(ingest.normalize(F.col("t"), F.col("is_text"))).collect()] == [("a", None), (None, "binary"), (None, "not_text"), (None, "not_text"), ("", None)]


def test_spread_leaves_what_is_behind_a_shuffle(spark):
    small = spark.range(10, numPartitions=1)
    assert base.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = small.groupBy("id").count()
    assert base.spread(grouped) is grouped and base.spread(base.spread(small)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_patterns_are_found_behind_their_words(spark):
    """The quick search never hides a match, whatever the case and the letters that fold to ASCII."""
    hits = ["use SUBPROCESS now", "x os.\u017fystem y", "DOC\u212aER", "a flask.Flask", "how To Use", "\\FRAC", "Q.E.D.", "dynam\u0131c programming", "#INCLUDE   <x>", "def f(): input (1)", "sys.stdin", "no hint here", "undocked flasks", ""]
    df = spark.createDataFrame([(t,) for t in hits], "t string")
    for name in ("OS_IO", "OTHER_LANG", "CP_IO", "UTILITY_IO", "OPEN_FILE", "TUTORIAL", "ALGO_HINT", "MATH_HINT"):
        pattern = getattr(tx, name)
        rows = df.select("t", tx.matches(F.col("t"), pattern), F.col("t").rlike(pattern)).collect()
        assert [r[1] for r in rows] == [r[2] for r in rows], (name, rows)


def test_a_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Frame:
        class sparkSession:  # noqa: N801
            sparkContext = Context()

    with pytest.raises(RuntimeError):
        base.checkpoint(Frame())


@pytest.mark.parametrize("seed", range(5))
def test_block_tables_compose_to_next_fit(seed):
    rng = random.Random(seed)
    for _ in range(200):
        cap, lengths = rng.randint(3, 30), None
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        seq = fill = 0
        for n in lengths:
            if fill + n > cap:
                seq, fill = seq + 1, 0
            fill += n
        s = f = 0
        cuts = sorted(rng.randint(0, len(lengths)) for _ in range(rng.randint(0, 5)))
        for a, b in zip([0, *cuts], [*cuts, len(lengths)]):
            c, f = apply_table(block_table(lengths[a:b], cap), f)
            s += c
        assert (s, f) == (seq, fill)
        whole = [(0, 0, 0)]
        for a, b in zip([0, *cuts], [*cuts, len(lengths)]):
            whole = packing.compose(whole, block_table(lengths[a:b], cap))
        assert [apply_table(whole, f) for f in range(cap + 1)] == [apply_table(block_table(lengths, cap), f) for f in range(cap + 1)]


def test_packing_in_many_blocks(spark):
    rng = random.Random(1)
    ids = [[rng.randint(4, 99) for _ in range(rng.randint(0, 30))] for _ in range(300)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(ids)], "source_id string, doc_id bigint, token_ids array<int>")
    flat, seqs, cur = 16, [], []
    for x in ids:
        if not x:
            continue
        x = x if x[-1] == 3 else [*x, 3]
        x = [*x[: flat - 1], 3] if len(x) > flat else x
        if len(cur) + len(x) > flat:
            seqs.append(cur + [0] * (flat - len(cur)))
            cur = []
        cur = cur + x
    seqs.append(cur + [0] * (flat - len(cur)))
    got = [r.token_ids for r in packing.sequences(df, n_ctx=flat).orderBy("seq_id").collect()]
    assert got == seqs
    slim = df.select("source_id", "doc_id", packing._packed_length("token_ids").alias("n_packed0"))
    placed = packing.assign(slim, n_ctx=flat, rows_a_block=20)
    assert {tuple(r) for r in packing.assign(slim, n_ctx=flat, rows_a_block=20, group=2).collect()} == {tuple(r) for r in placed.collect()}
    assert placed.agg(F.max("seq_id")).first()[0] + 1 == len(seqs)
    assert packing.validate(packing.sequences(df, n_ctx=flat)).first().n_out_of_range == 0


def test_mixture_cap_skips_what_does_not_fit(spark):
    rng = random.Random(2)
    rows = [("s", i, rng.choice(["python", "math", "other"]), rng.randint(1, 60)) for i in range(200)]
    df = spark.createDataFrame(rows, "source_id string, doc_id bigint, domain string, token_count int")
    targets, used, want = {"python": 500, "math": 130}, {"python": 0, "math": 0}, set()
    for _, i, d, n in rows:
        if d in used and used[d] + n <= targets[d]:
            used[d] += n
            want.add(i)
    for at_once in (500_000, 0):
        kept, removed = mixture.mixture_cap(df, targets, rows_a_block=30, at_once=at_once)
        assert {r.doc_id for r in kept.collect()} == want and removed.count() == 200 - len(want)


def test_metrics_are_safe_for_nothing(spark):
    assert metrics.stage_rates(0, {"exact_dedup": 0, "near_dedup": 0}) == [("exact_dedup", 0, 0, 0.0), ("near_dedup", 0, 0, 0.0)]
    empty = docs(spark, [])
    assert {r.tokens for r in metrics.domain_deviation(empty).collect()} == {0}
    assert dedup.exact_dedup(empty)[0].count() == 0 and quality.apply_quality(empty)[1].count() == 0


def test_signatures_wrap_modulo_two_to_64():
    v = minhash_values("overflow " * 5, 128, 5)
    assert v.dtype == np.uint64 and len(v) == 128


def test_funnel_query_has_rows_for_every_stage(spark, tiny):
    from lodewright.plans.queries import QUERIES

    got = {r.stage: r for r in QUERIES["stage_funnel"](spark, tiny).collect()}
    assert got["ingest"].n_removed > 0 and got["packing"].n_kept > 0


def test_whole_histogram_counts_syntax(spark, tiny):
    from lodewright.plans.queries import QUERIES

    part, whole = ({r.code: r.n for r in QUERIES[q](spark, tiny).collect()} for q in ("reason_histogram", "reason_histogram_whole"))
    assert whole.pop("syntax_invalid") > 0 and whole == part
