import random
from itertools import combinations

import pytest

from lodewright.llm import formatdup, neardup

R = random.Random(9)
VOCAB = [a + b for a in ("sto", "riv", "clo", "men", "tas", "ber") for b in ("ne", "er", "ud", "tal", "k", "ry", "lin", "ox")]


def text(n):
    return " ".join(R.choice(VOCAB) + R.choice(["", "s", "ed", "ing"]) for _ in range(n))


def jaccard(a, b):
    s, t = ({x[i : i + 5] for i in range(len(x) - 4)} for x in map(neardup.normal, (a, b)))
    return len(s & t) / len(s | t) if s and t else 0.0


def corpus():
    rows = []
    for _ in range(25):
        base = text(60).split()
        for e in range(R.randint(1, 5)):
            t = base[:]
            for _ in range(e * 2):
                t[R.randrange(len(t))] = R.choice(VOCAB) + "x"
            rows.append(" ".join(t))
    rows += ["", None, "ab", "!!!", "short text here", "Short,  TEXT here!", rows[0].upper(), rows[0]]
    return [(1000 + 3 * i, t) for i, t in enumerate(rows)]


def brute_same(rows):
    return {i: formatdup.letters(t) for i, t in rows if t and formatdup.letters(t)}


def test_pairs_equal_brute_force(frame):
    rows = corpus()
    df = frame([*rows, rows[0], (None, rows[1][1])], "doc_id bigint, text string")
    _, same = formatdup.collapse(df)
    got = {tuple(r) for r in neardup.near_duplicates(df, same, 0.7).collect()}
    key = brute_same(rows)
    want = {(a, b) for (a, s), (b, t) in combinations(rows, 2) if s and t and key.get(a) != key.get(b) and jaccard(s, t) >= 0.7}
    assert want and got == want


def test_exact_mode_crowded_bands_and_many_pivots_agree(frame):
    rows = corpus()
    df = frame(rows, "doc_id bigint, text string")
    want = {(a, b) for (a, s), (b, t) in combinations(rows, 2) if s and t and jaccard(s, t) >= 0.7 and neardup.normal(s) != neardup.normal(t)}
    first = {}
    for i, t in rows:
        first.setdefault(neardup.normal(t or ""), i)
    reps = set(first.values())
    want = {p for p in want if set(p) <= reps}
    for how in ({"exact": True}, {"hot": 1}, {"pivots": 20}):
        pairs, _ = neardup.similar_classes(df, 0.7, **how)
        assert {(r.a, r.b) for r in pairs.collect()} == want, how
    assert neardup.similar_classes(df.limit(0), 0.7, exact=True)[0].count() == 0


def test_short_texts_beyond_the_radius(frame):
    """Similar texts of few grams whose fingerprints differ in 66 and 70 bits, more than the radius of 62."""
    rows = [(1, "cgsfycyvpmglkycz"), (2, "fycyvpmglkycz"), (3, "ykcazypdebqpjzifejbs"), (4, "ykcazypdebqpjzifejbskmirfr"), (5, "another text of its own")]
    df = frame(rows, "doc_id bigint, text string")
    _, same = formatdup.collapse(df)
    assert {tuple(r) for r in neardup.near_duplicates(df, same, 0.7).collect()} == {(1, 2), (3, 4)}


def test_groups_give_one_row_per_document(frame):
    rows = corpus()
    got = {r.doc_id: r for r in neardup.groups(frame(rows, "doc_id bigint, text string"), 0.7).collect()}
    assert len(got) == sum(1 for _, t in rows if t and len(neardup.normal(t)) >= 5)
    key = {i: neardup.normal(t) for i, t in rows if t}
    for (a, s), (b, t) in combinations([r for r in rows if r[0] in got], 2):
        if key[a] == key[b] or jaccard(s, t) >= 0.7:
            assert got[a].class_id == got[b].class_id


def test_nothing_in_nothing_out(frame):
    df = frame([], "doc_id bigint, text string")
    texts, members = formatdup.collapse(df)
    assert texts.count() == members.count() == 0
    assert neardup.near_duplicates(df, members).count() == 0
    assert neardup.groups(df).count() == 0
    only = frame([(1, None), (2, "")], "doc_id bigint, text string")
    assert neardup.groups(only).count() == 0 and formatdup.copies(only).count() == 0 and formatdup.collapse(only)[0].count() == 2


def test_pivot_filter_never_drops_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(0)
    fp = rng.integers(0, 256, (200, 32), dtype=np.uint8)
    pivots = neardup.choose_pivots([f.tobytes() for f in fp], 8)
    d = np.stack([np.bitwise_count(fp ^ p).sum(1, dtype=int) for p in pivots], 1)
    for i in range(0, 200, 7):
        exact = np.bitwise_count(fp ^ fp[i]).sum(1, dtype=int)
        assert (np.abs(d - d[i]).max(1) <= exact).all()


@pytest.mark.parametrize("n", [5, 6, 30, 3000])
def test_sketch_estimates_similarity(n):
    a = text(n)
    b = a[: int(len(a) * 0.9)] + text(max(1, n // 10))
    s, t = (neardup.sketch(neardup.gram_hashes(neardup.normal(x))) for x in (a, b))
    assert abs((s == t).mean() - jaccard(a, b)) < 0.2


def test_format_copies(frame):
    lines = "name: Ada L.\nage: 36\ncity: London\nnote: first, of many"
    as_json = '{"city": "london", "Name": "ada l", "note": "First of many", "age": 36}'
    rows = [
        (5, "Hello, World"), (3, "hello world"), (9, "HELLO\tWORLD!!"), (4, "hello worlds"), (20, lines), (21, as_json), (22, "age: 36\nNAME: Ada L\n\nnote: first of many\ncity: London\n"),
        (23, "age: 36\nname: Ada L\nnote: first of many"), (30, None), (31, ""), (32, "…"), (33, "…"), (40, "é"), (41, "É"), (42, "e"), (50, "x" * 500_000), (51, "X " * 500_000), (3, "hello world"),
        (60, '{"a": {"z": 1, "y": [1, 2]}, "b": null}'), (61, '{"b": null, "a": {"z": 1, "y": [1, 2]}}'), (62, '{"broken": '), (63, "[1, 2]"),
    ]
    got = {tuple(r) for r in formatdup.copies(frame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(3, 5), (3, 9), (20, 21), (20, 22), (40, 41), (50, 51), (60, 61)}
    texts, _ = formatdup.collapse(frame(rows, "doc_id bigint, text string"))
    n = {r.first_doc_id: r.copies for r in texts.collect()}
    assert n[3] == 4 and n[20] == 3 and n[30] == n[32] == n[33] == 1
    assert sum(n.values()) == len(rows)


def test_letters_alone_link_records_and_plain_texts(frame):
    record, flat = "a: 1\nb: 2\nc: 3\nd: 4", "a 1 b 2 c 3 d 4"
    rows = [(1, "d: 4\nc: 3\nb: 2\na: 1"), (2, record), (3, flat)]
    assert {tuple(r) for r in formatdup.copies(frame(rows, "doc_id bigint, text string")).collect()} == {(1, 2), (1, 3)}


def test_letters_in_other_encodings_are_the_same(frame):
    same = [("caf\u00e9 au lait", "CAFE\u0301 au lait"), ("\uff21\uff22 two", "ab TWO"), ("Stra\u00dfe eins", "STRASSE EINS"), ("\u03a3\u0391\u03a3 \u0391", "\u03c3\u03b1\u03c2 \u03b1")]
    rows = [(10 * i + j, t) for i, pair in enumerate(same) for j, t in enumerate(pair)] + [(90, "cafe au lait"), (91, "caf au lait")]
    got = {tuple(r) for r in formatdup.copies(frame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(10 * i, 10 * i + 1) for i in range(len(same))}


def test_colliding_hashes_stay_apart_and_are_counted(frame, monkeypatch, spark):
    keyed = spark.createDataFrame([(1, b"k", 1, None), (2, b"k", 2, None), (3, b"k", 2, None), (4, b"m", 7, b"f" * 16 + b"a" * 8), (5, b"n", 8, b"f" * 16 + b"b" * 8)], "doc_id bigint, k binary, check bigint, f binary")
    assert tuple(formatdup.collisions(keyed).first()) == (4, 1, 2, 1)
    monkeypatch.setattr(formatdup, "canonical_keys", lambda *a, **k: keyed)
    texts, members = formatdup.collapse(keyed)
    assert {tuple(r) for r in members.collect()} == {(1, 1), (2, 2), (2, 3), (4, 4), (5, 5)}
    assert {tuple(r) for r in texts.collect()} == {(1, 1), (2, 2), (4, 1), (5, 1)}
    assert tuple(formatdup.collisions(keyed.limit(0)).first()) == (0, 0, 0, 0)
