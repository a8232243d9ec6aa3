import random

import pytest

from lodewright.llm import leakage

R = random.Random(4)
WORDS = [a + b for a in ("bra", "cle", "dro", "fim", "gou", "hex", "jil", "kro") for b in ("nde", "sta", "vor", "pix", "lum", "tag", "zen", "qui", "mar", "bol")]


def passage(n, rng=R):
    return [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n)]


ITEM = passage(60)
OTHER = passage(70)


def found(frame, rows, items):
    recs = frame([("documents", i, t) for i, t in rows], "tbl string, rec_id bigint, text string")
    bench = frame(items, "item_id bigint, text string")
    return {(r.rec_id, r.item_id) for r in leakage.leaks(recs, bench).collect()}


def test_planted_cases(frame):
    changed = [w if i % 9 else "other" for i, w in enumerate(ITEM[:30])]
    shuffled = ITEM[:]
    random.Random(1).shuffle(shuffled)
    pad = passage(40)
    rows = [
        (1, " ".join(ITEM)),
        (2, ("> " + "\n> ".join(" ".join(ITEM[i : i + 7]) for i in range(0, 60, 7))).upper()),
        (3, " ".join(pad + ITEM[10:34] + pad)),
        (4, " ".join(pad[:20] + ITEM[5:18] + pad[20:30] + ITEM[30:44])),
        (5, " ".join(pad + changed + pad)),
        (6, " ".join(pad + ITEM[:10] + pad)),  # a short quotation
        (7, " ".join(shuffled)),  # another order
        (8, " ".join(passage(200))),
        (9, None),
        (10, ""),
        (11, "…!?"),
        (12, " ".join(passage(30_000) + ITEM[20:50])),  # very long
        (12, " ".join(passage(30_000) + ITEM[20:50])),
        (None, " ".join(ITEM)),
    ]
    items = [(100, " ".join(ITEM)), (101, " ".join(ITEM)), (102, " ".join(OTHER)), (103, "too short"), (None, "x"), (104, None)]
    got = found(frame, rows, items)
    want = {r for r in (1, 2, 3, 4, 5, 12, None)}
    assert got == {(r, i) for r in want for i in (100, 101)}


def test_blocks_agree_with_one_pass(frame, monkeypatch):
    items = [(i, " ".join(passage(40))) for i in range(12)]
    rows = [(i, " ".join(passage(30)) + " " + items[i % 12][1]) for i in range(30)]
    whole = found(frame, rows, items)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    assert len(leakage.item_blocks(items)) > 3
    assert found(frame, rows, items) == whole == {(i, i % 12) for i in range(30)}


def test_item_in_a_third_of_the_records(frame):
    """A leak in very many records is no boilerplate; a phrase of many items in very many records is."""
    rows = [(i, " ".join(passage(20) + (ITEM[:40] if i % 3 == 0 else []) + passage(20))) for i in range(300)]
    assert found(frame, rows, [(100, " ".join(ITEM)), (102, " ".join(OTHER))]) == {(i, 100) for i in range(0, 300, 3)}
    phrase = passage(25)
    items = [(i, " ".join(passage(20) + phrase + passage(20))) for i in range(12)]
    rows = [(i, " ".join(passage(20) + phrase + passage(20))) for i in range(100)] + [(200, items[5][1])]
    assert found(frame, rows, items) == {(200, 5)}


def changed_every(ws, k):
    return [w if (i + 1) % k else "other" for i, w in enumerate(ws)]


def test_twenty_words_with_changes(frame):
    parts = [w for k in range(0, 20, 5) for w in [*ITEM[k : k + 5], *passage(7)]]
    scattered = [w for k in range(0, 60, 15) for w in [*ITEM[k : k + 5], *passage(7)]]
    leaks = [changed_every(ITEM[:23], 6), changed_every(ITEM[:26], 6), changed_every(ITEM[:26], 5), changed_every(ITEM[:28], 4), changed_every(ITEM, 4), parts, scattered]
    phrases = [w for k in range(0, 60, 9) for w in [*ITEM[k : k + 3], *passage(7)]]  # phrases of a template look like this
    rows = [(k, " ".join(passage(30) + ws + passage(30))) for k, ws in enumerate([*leaks, phrases, changed_every(ITEM[:24], 6)[:19], changed_every(ITEM, 2)])]
    assert found(frame, rows, [(100, " ".join(ITEM)), (102, " ".join(OTHER))]) == {(k, 100) for k in range(len(leaks))}


@pytest.mark.parametrize("n", [30, 31, 100])
def test_hot_item_among_many_records(frame, n):
    rows = [(i, " ".join(passage(20) + (ITEM if i < n else []) + passage(20))) for i in range(2_000)]
    assert found(frame, rows, [(100, " ".join(ITEM)), (102, " ".join(OTHER))]) == {(i, 100) for i in range(n)}


@pytest.mark.parametrize("gap", [361, 400, 1_000])
def test_two_passages_at_any_distance(frame, gap):
    rows = [(1, " ".join(passage(30) + ITEM[5:20] + passage(gap) + ITEM[30:45] + passage(30)))]
    assert found(frame, rows, [(100, " ".join(ITEM))]) == {(1, 100)}


def test_bounds_keep_what_can_be_a_case():
    """Two windows of one item: hits too few for a window go, and pairs with too few different shingles."""
    arr = leakage.np.array
    p = arr([*range(6), 5_000, *range(3), *range(6)])
    q = arr([*range(6), 9, *range(3), *[2] * 6])
    pair = arr([0] * 7 + [1] * 3 + [2] * 6)
    keep = leakage._within_bounds(pair, p, q, leakage.np.full(16, 360))
    assert keep.tolist() == [True] * 6 + [False] * 10


def test_passages_far_apart(frame):
    far = [(1, " ".join(ITEM[5:20] + passage(5_000) + ITEM[30:45])), (2, " ".join(ITEM[30:45] + passage(5_000) + ITEM[5:20]))]
    assert found(frame, far, [(100, " ".join(ITEM)), (102, " ".join(OTHER))]) == {(1, 100)}


def test_empty_tables(frame):
    assert found(frame, [], [(1, " ".join(ITEM))]) == set()
    assert found(frame, [(1, " ".join(ITEM))], []) == set()


def test_chain_needs_order():
    assert leakage.chain([(0, 30, 10, 5, 10), (12, 0, 10, 5, 10)], 100) == (10, 5)
    assert leakage.chain([(0, 0, 10, 5, 10), (12, 12, 10, 5, 10)], 100) == (20, 10)
    assert leakage.chain([(0, 0, 10, 5, 10), (500, 12, 10, 5, 10)], 100) == (10, 5)
