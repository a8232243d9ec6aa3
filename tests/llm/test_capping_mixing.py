import math
import random

import pytest
from pyspark.sql import functions as F

from lodewright.llm import capping, mixing

SCHEMA = "row_id bigint, problem string, score double, ok boolean"


def brute(rows, limit=8):
    by = {}
    for i, p, s, ok in rows:
        if p is not None and ok is not False:
            v = s if s is not None and not math.isnan(s) and 0 <= s <= 5 else -1.0
            by.setdefault(p, []).append((-v, math.inf if i is None else i))
    return {p: sorted(x)[limit:] for p, x in by.items() if len(x) > limit}


def run(frame, rows, **kw):
    df = frame(rows, SCHEMA)
    out = capping.cap(df, who=F.col("problem"), score=F.col("score"), identifier=F.col("row_id"), eligible=~F.col("ok").eqNullSafe(False), **kw)
    return out.collect()


@pytest.mark.parametrize("scores", ["ties", "floats", "dirty", "one"])
def test_cut_rows_equal_a_sort(frame, scores, monkeypatch):
    monkeypatch.setattr(capping, "SMALL", 20)
    rng = random.Random(scores)
    pick = {
        "ties": lambda: float(rng.randint(0, 5)), "floats": lambda: rng.random() * 5, "one": lambda: 2.5,
        "dirty": lambda: rng.choice([None, math.nan, -3.0, 99.0, 0.0, 5.0, -0.0, 4.999999999, 5e-324, math.inf]),
    }[scores]
    rows = [(rng.randint(-(10**12), 10**12), "hot" if rng.random() < 0.6 else f"p{rng.randint(0, 40)}", pick(), rng.choice([True, True, None, False])) for _ in range(900)]
    rows += [(1, None, 5.0, True), (2, "solo", None, None)]
    got = {}
    for r in run(frame, rows):
        if not r.kept:
            got.setdefault(r.who, []).append(r.id)
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(i for _, i in x) for p, x in brute(rows).items()}


def test_repeated_and_null_ids_keep_exactly_the_limit(frame):
    rows = [(7, "p", 3.0, True)] * 20 + [(None, "q", 1.0, None)] * 9 + [(1, "q", 1.0, True)]
    got = run(frame, rows)
    assert sum(r.kept for r in got if r.who == "p") == 8 and sum(r.kept for r in got if r.who == "q") == 8 and len(got) == 30
    assert any(r.kept for r in got if r.who == "q" and r.id == 1)


def test_share_empty_and_zero(frame):
    rows = [(i, f"p{i % 2}", 1.0, True) for i in range(40)]
    assert sum(r.kept for r in run(frame, rows, share=0.1)) == 8
    assert run(frame, []) == []
    assert not any(r.kept for r in run(frame, rows, limit=0))


@pytest.mark.parametrize("rate,cap", [(0.0, 3), (0.2, 1), (0.7, 2), (1.9, 2), (2.0, 2), (3.3, 4), (5.0, 4)])
def test_poisson_mean_is_the_rate(rate, cap):
    steps = mixing.poisson_steps(rate, cap)
    assert len(steps) == cap and steps == sorted(steps)
    assert sum(1 - c for c in steps) == pytest.approx(min(rate, cap), abs=1e-9)


def tables(frame, spark, n=3000):
    rng = random.Random(0)
    man = frame(
        [(1, "Big ", "python", 100_000, "admitted", 1), (2, "small", "math", 5_000, "admitted", 1), (3, "tiny", "stem", -1, "admitted", 1), (4, "tiny", "stem", 2_000, "admitted", 2), (5, "shut", "math", 9_999, "blocked", 1), (6, None, "math", 5, "admitted", 1)],
        "manifest_id bigint, source_id string, domain string, token_count bigint, status string, recorded_at bigint",
    )
    runs = spark.sql(
        """SELECT * FROM VALUES
        (1L, 1, named_struct('python', 20000L, 'math', 6000L, 'stem', 4000L, 'total', 30000L), named_struct('python', 1L, 'math', 1L, 'stem', 1L, 'total', 3L), 3),
        (1L, 2, named_struct('python', 20000L, 'math', 8000L, 'stem', 4000L, 'total', 32000L), named_struct('python', 2L, 'math', 1L, 'stem', 1L, 'total', 4L), 3),
        (2L, 1, named_struct('python', 20000L, 'math', 20000L, 'stem', 20000L, 'total', 60000L), NULL, NULL),
        (3L, 1, NULL, NULL, 2), (NULL, 1, NULL, NULL, 2) AS t(run_id, created_at, target_10m, actual, max_repeats)"""
    )
    docs = frame([(i, rng.choice(["big", "SMALL", "tiny ", "shut", None]), "x" * rng.randint(0, 400)) for i in range(n)] + [(None, "big", None)], "doc_id bigint, source string, text string")
    return man, runs, docs


def test_mixture_reaches_the_shares(frame, spark):
    man, runs, docs = tables(frame, spark)
    r = mixing.rates(man, runs)
    got = {(x.run_id, x.domain): x for x in mixing.shares(docs, r, runs).collect()}
    assert set(got) == {(n, d) for n in (1, 2) for d in ("python", "math", "stem")}
    for x in got.values():
        assert x.reached_share == pytest.approx(x.wanted_share, abs=0.06)  # the draw is random, some hundred documents a source
        assert x.most_passes <= x.max_repeats + 1e-9
    assert got[1, "math"].wanted_tokens == 8000 and got[1, "math"].actual_share == 0.25 and got[2, "math"].actual_tokens is None
    copies = mixing.mixture(docs, r)
    assert {c.source for c in copies.collect()} == {"big", "small", "tiny"}
    most = copies.groupBy("run_id", "doc_id").agg(F.count("*").alias("m"), F.max("copy").alias("c")).collect()
    assert all(x.m == x.c for x in most)
    again = {tuple(x) for x in mixing.mixture(docs, r).collect()}
    assert again == {tuple(x) for x in copies.collect()}
    assert {tuple(x) for x in mixing.mixture(docs, r, seed=7).collect()} != again


def test_nothing_to_mix(frame, spark):
    man, runs, docs = tables(frame, spark, 5)
    assert mixing.mixture(docs.limit(0), mixing.rates(man, runs)).count() == 0
    empty = mixing.rates(man.limit(0), runs)
    assert mixing.mixture(docs, empty).count() == 0
    assert {(r.reached_tokens, r.reached_share, r.drawn_bytes) for r in mixing.shares(docs, empty, runs).collect()} == {(0.0, None, 0)}
    assert mixing.shares(docs, mixing.rates(man, runs.limit(0)), runs).count() == 0


def test_wanted_domain_without_source_is_listed(frame, spark):
    man = frame([(1, "big", "python", 100_000, "admitted", 1), (2, "shut", "math", 9_999, "blocked", 1)], "manifest_id bigint, source_id string, domain string, token_count bigint, status string, recorded_at bigint")
    runs = spark.sql("SELECT 1L AS run_id, 1 AS created_at, named_struct('python', 500L, 'math', 500L, 'stem', NULL) AS target_10m, named_struct('python', 3L, 'math', 1L, 'stem', NULL) AS actual, 3 AS max_repeats")
    docs = frame([(i, "big" if i % 2 else "shut", "x" * 50) for i in range(4_000)], "doc_id bigint, source string, text string")
    got = {r.domain: r for r in mixing.shares(docs, mixing.rates(man, runs), runs).collect()}
    assert set(got) == {"python", "math"}
    assert (got["math"].wanted_share, got["math"].planned_tokens, got["math"].reached_tokens, got["math"].reached_share, got["math"].drawn_bytes) == (0.5, 0.0, 0.0, 0.0, 0)
    assert got["python"].wanted_share == 0.5 and got["python"].reached_share == 1.0 and got["python"].drawn_bytes > 0 and got["python"].planned_tokens == 500
    assert got["python"].actual_share == 0.75
