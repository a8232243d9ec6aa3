from collections import Counter

import pytest

from lodewright.functions.code import parses
from lodewright.llm.oracle import ORACLE
from lodewright.llm.queries import QUERIES
from tests.util import same_rows, tables


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, tiny, name):
    same_rows(QUERIES[name](spark, tiny), ORACLE[name], tables(tiny))


def test_what_has_no_sql():
    """Leaks, parsers, a tokenizer and what is sized by it, and a fitted formula; the tests below hold their queries against each other."""
    assert set(QUERIES) - set(ORACLE) == {"p1_found", "p1_items", "p6_found", "p6_rates", "p7_ids", "p8_containers", "p8_waste", "p9_found", "p9_levels"}


def test_leak_report_counts_the_leaks(spark, tiny):
    found = [tuple(r) for r in QUERIES["p1_found"](spark, tiny).collect()]
    items = {r.item_id: r for r in QUERIES["p1_items"](spark, tiny).collect()}
    assert found and len(set(found)) == len(found)
    assert set(items) == {r[0] for r in tables(tiny).execute("SELECT item_id FROM benchmark").fetchall()}
    for tbl, col in (("documents", "in_documents"), ("corpus", "in_corpus")):
        assert {i: r[col] for i, r in items.items() if r[col]} == dict(Counter(i for t, _, i in found if t == tbl))


def test_syntax_rates_count_every_tagged_file(spark, tiny):
    rates = QUERIES["p6_rates"](spark, tiny).collect()
    found = {tuple(r) for r in QUERIES["p6_found"](spark, tiny).collect()}
    n = tables(tiny).execute("""SELECT (SELECT count(*) FROM corpus WHERE generated_solution <> '' AND trim(language_tag) <> '') + (SELECT count(*) FROM documents WHERE solution <> '' AND trim(language_tag) <> '')""").fetchone()[0]
    assert sum(r.n_files for r in rates) == n and sum(r.n_invalid for r in rates) == len(found) > 0
    # Python's own parser is the judge of Python files.
    rows = tables(tiny).execute("SELECT row_id, generated_solution FROM corpus WHERE generated_solution <> '' AND replace(lower(language_tag), ' ', '') IN ('python', 'python3', 'py', 'py3')").fetchall()
    assert {i for i, t in rows if not parses(t)} == {i for t, i in found if t == "corpus"} & {i for i, _ in rows}


def test_containers_hold_every_token_once(spark, tiny):
    sizes = {r.doc_id: len(r.ids) for r in QUERIES["p7_ids"](spark, tiny).collect()}
    assert len(sizes) == tables(tiny).execute("SELECT count(*) FROM documents").fetchone()[0]
    placed = QUERIES["p8_containers"](spark, tiny).collect()
    report = {r.n_ctx: r for r in QUERIES["p8_waste"](spark, tiny).collect()}
    assert report
    for n_ctx, line in report.items():
        rows = [r for r in placed if r.n_ctx == n_ctx]
        held, used = Counter(), Counter()
        for r in rows:
            held[r.doc_id] += r.n_tokens
            used[r.container_id] += r.n_tokens
        assert {i: n for i, n in held.items() if n} == {i: n for i, n in sizes.items() if n}
        used.pop(None, None)
        assert max(used.values()) <= n_ctx and len(used) == line.n_containers and sum(used.values()) == line.packed_tokens
        assert all(r.container_used == used[r.container_id] for r in rows if r.container_id is not None)
        assert line.least_containers <= line.n_containers <= 1.12 * line.least_containers + 1


def test_levels_and_hard_texts_agree(spark, tiny):
    levels = QUERIES["p9_levels"](spark, tiny).collect()
    hard = {r.doc_id for r in QUERIES["p9_found"](spark, tiny).collect()}
    assert {r.doc_id for r in levels if (r.domain or "").strip().lower() == "stem" and (r.reading_level or 0) >= 4} == hard


def test_found_columns(spark, tiny):
    want = {"p1_found": ["tbl", "rec_id", "item_id"], "p2_found": ["doc_id_a", "doc_id_b"], "p3_found": ["row_id"], "p5_found": ["first_doc_id", "doc_id"], "p6_found": ["tbl", "rec_id"], "p9_found": ["doc_id"], "p7_ids": ["doc_id", "ids"]}
    for name, cols in want.items():
        assert QUERIES[name](spark, tiny).columns == cols


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import lodewright

    root = Path(lodewright.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "lodewright.llm" in p.read_text()]
