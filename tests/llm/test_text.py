import os
import random

import pytest

from lodewright.llm import bpe, packing, reading
from lodewright.llm.common import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")
needs_file = pytest.mark.skipif(not os.path.exists(FILE), reason="the public tokenizer is not there")
ODD = ["", "a", " ", "\n\n\n  x", "<|endoftext|>", "it's I'LL don't", "\x00\x01\x1c\x1d\x85", "    x 　", "é" * 90, "한글 🙂🔥", "a" * 5000, " " * 3000, "1234567890" * 40, "\r\n\t\x0b\x0c", "_-_" * 30, "á ﬁ Ⅷ ²"]


@needs_file
def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcdet hinsor\n\t'_=-<0129éß한.") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeinstrolu") for _ in range(rng.randint(1, 120))) for _ in range(800)]
    enc = bpe.encoder(FILE)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [enc.encode(x) for x in texts] == want


@needs_file
def test_whole_column(frame, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "twice", "twice"])] + [(None, "x")]
    got = bpe.token_ids(frame(rows, "doc_id bigint, text string")).collect()
    enc = bpe.encoder(FILE)
    assert sorted((repr(r.doc_id), list(r.ids)) for r in got) == sorted((repr(i), enc.encode(t)) for i, t in rows)
    n = {r.doc_id: r.n_tokens for r in bpe.token_counts(frame(rows, "doc_id bigint, text string")).collect()}
    assert n == {i: len(enc.encode(t)) for i, t in rows}
    assert bpe.token_ids(frame([], "doc_id bigint, text string")).count() == 0
    monkeypatch.setattr(bpe, "MAX_CACHED_PIECES", 2)
    assert bpe.BytePairEncoder(FILE).encode("a few words, a few words") == enc.encode("a few words, a few words")


def bins_ok(sizes, capacity):
    bins = packing.fill(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_filling_is_valid_and_near_the_bound(seed):
    rng = random.Random(seed)
    for cap, top in ((100, 30), (100, 100), (1000, 400), (7, 7)):
        sizes = [rng.randint(1, top) for _ in range(rng.randint(0, 600))]
        n = bins_ok(sizes, cap)
        assert n <= packing.least_bins(sizes, cap) * 1.15 + 2 if sizes else n == 0
    assert bins_ok([5] * 40, 5) == 40 and bins_ok([1] * 100, 10) == 10


def test_lower_bound_is_one():
    import itertools

    rng = random.Random(1)
    for _ in range(60):
        sizes, cap = [rng.randint(1, 10) for _ in range(6)], 12
        least = min(max(p) + 1 for p in itertools.product(range(6), repeat=6) if all(sum(s for s, q in zip(sizes, p) if q == b) <= cap for b in range(6)))
        assert packing.least_bins(sizes, cap) <= least


def test_differencing_of_the_textbook():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in b) for b in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_containers(frame, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_BLOCK", 50)
    rng = random.Random(0)
    rows = [(i, rng.randint(0, 300)) for i in range(400)] + [(900, 64), (901, 128), (902, None), (902, None), (5, 70), (None, 20), (None, 20)]
    got = packing.pack(frame(rows, "doc_id bigint, n_tokens bigint"), [64, 256, None, 0, 64], containers_a_block=8).collect()
    for cap in (64, 256):
        mine = [r for r in got if r.n_ctx == cap]
        per = {}
        for r in mine:
            if r.container_id is not None:
                per[r.container_id] = per.get(r.container_id, 0) + r.n_tokens
        assert all(v <= cap for v in per.values())
        assert all(per[r.container_id] == r.container_used and r.container_waste == cap - r.container_used for r in mine if r.container_id is not None)
        assert sum(r.n_tokens for r in mine) == sum(n or 0 for _, n in rows)
        whole = [r for r in mine if r.doc_id == 900]
        assert len(whole) == 1
        assert sorted((r.piece, r.start, r.n_tokens) for r in mine if r.doc_id == 901) == ([(0, 0, 64), (1, 64, 64)] if cap == 64 else [(0, 0, 128)])
        assert [r.container_id for r in mine if r.doc_id == 902] == [None, None]
    assert packing.pack(frame([], "doc_id bigint, n_tokens bigint"), [64]).count() == 0
    assert packing.pack(frame([(1, 5)], "doc_id bigint, n_tokens bigint"), []).count() == 0


EASY = "the cat sat on the mat and the dog ran to the red barn by the river".split()
HARD = "empirical attribution substantiates methodological discretization whereas asymptotic convergence undermines heterogeneity notwithstanding".split()


def level_tables(frame, seed=0, n=400):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        hard = rng.random() < 0.3
        words = [rng.choice(HARD if hard and rng.random() < 0.5 else EASY) for _ in range(rng.randint(40, 90))]
        t, step = [], rng.randint(5, 20)
        for k in range(0, len(words), step):
            t.append(" ".join(words[k : k + step]).capitalize() + ".")
        docs.append((i, "stem" if i % 5 else "math", " ".join(t)))
        truth[i] = hard
        if i < n // 2:
            level = rng.choice([4, 5]) if hard else rng.choice([1, 2, 3])
            labels += [(i, "r1", level), (i, "r1", level), (i, "r2", 9), (i, "r3", None)]
            if rng.random() < 0.06:
                labels[-4:] = [(i, "r1", 6 - level)]
    docs += [(9001, "stem", None), (9002, "stem", ""), (9003, "stem", "12 34 !!"), (9004, None, "The cat sat."), (9005, "stem", "the " * 100_000)]
    labels += [(None, "r", 3), (777777, "r", 5)]
    return frame(docs, "doc_id bigint, domain string, text string"), frame(labels, "doc_id bigint, rater string, reading_level int"), truth


def test_levels_on_held_out_texts(frame):
    docs, labels, truth = level_tables(frame)
    got = {r.doc_id: r for r in reading.levels(docs, labels).collect()}
    held = [i for i in truth if i >= 200]
    right = sum((got[i].reading_level >= 4) == truth[i] for i in held)
    assert right / len(held) >= 0.97
    assert all((got[i].reading_level >= 4) == (got[i].hard >= 0.5) for i in held)
    assert [got[i].reading_level for i in (9001, 9002, 9003)] == [None] * 3 and got[9005].reading_level is not None


def test_without_ratings_levels_are_null(frame):
    docs, labels, _ = level_tables(frame, n=20)
    assert {r.reading_level for r in reading.levels(docs, labels.limit(0)).collect()} == {None}
    assert reading.levels(docs.limit(0), labels).count() == 0


def test_document_frequencies_are_exact(frame, monkeypatch):
    monkeypatch.setattr(reading, "_FLUSH", 3)
    docs = frame([(1, "stem", "The cat the CAT"), (2, "stem", "the dog"), (3, "math", None), (4, "math", "")], "doc_id bigint, domain string, text string")
    assert reading.familiar(docs, 0.1) == {"the": 1.0, "cat": 0.5, "dog": 0.5}


def test_sentences():
    assert reading.sentences("One. Two! Three?") == 3
    assert reading.sentences("pi is 3.14 or so") == 1
    assert reading.sentences("") == 1
