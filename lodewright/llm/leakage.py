"""Problem 1: evaluation texts in training text, by a prefix-filtered join of word shingles.

1. Items are cut into shingles of three words, the longest run that is left where every fourth word is
   changed. One pass over all records counts the records that hold each shingle of an item (only
   shingles of items are counted, each partition adds up its own).
2. Per item the shingles are ordered by rarity. A leak of OVERLAP item shingles must hold one of the
   item's n - OVERLAP + 1 rarest, so a second pass looks only for these prefixes. Boilerplate, never
   evidence, is a shingle of many different item texts that also is in many records: an item that
   leaks into however many records makes none of its own shingles boilerplate.
3. Length bound: a record and an item must share OVERLAP different shingles that are evidence. Position
   bound: hits fall into windows, cut where no passage may follow the one before (more than REACH item
   lengths lie between); a window of fewer than FAR hits can only stand alone, which takes OVERLAP hits.
4. Candidates are verified exactly, on whole texts: maximal runs of equal words are chained in the
   order of both texts; the chain must hold LEAST_WORDS words and enough evidence: PLAIN rare shingles,
   or OVERLAP where its passages adjoin in the item. Templates share as much only in scattered phrases.

Items are taken in blocks of bounded vocabulary and size, each block is one pass, so a large benchmark
needs neither a large broadcast nor a join of everything with everything. A block holds about ten
thousand items of a hundred words.

Not found: texts in which no three words in a row are those of the item (every third word changed).

Defined results: null and empty texts leak nothing; items of fewer than LEAST_WORDS words cannot
leak. An item under two ids gives a case for each. Repeated records give repeated input but one row.
Rows of null ids come out with that null id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.llm.common import WORD, spread

SHINGLE = 3
LEAST_WORDS = 20
OVERLAP = 6  # LEAST_WORDS in passages of three words keep so many shingles
PLAIN = 12  # rare shingles that tell a leak from a template wherever in the item they are
REACH = 6  # item lengths that may lie between two passages,
FAR = 5  # unless both hold so many rare shingles (seven words): they may lie at any distance
RARE = 0.002  # boilerplate is in more than this part of all records
SHARED = 8  # and in more than so many different item texts
BLOCK_WORDS = 200_000  # distinct words of the items of one pass: three of them fit 60 bits
BLOCK_SHINGLES = 1_000_000  # and their shingles, about 50 bytes each
_BITS = 20


class ItemBlock:
    """Shingle index of some items; small and bounded, it is sent to the workers as it is."""

    def __init__(self, items: list[tuple[int, list[str]]], texts_of: Counter[tuple[str, ...]]) -> None:
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        codes, item, pos = [], [], []
        for k, ws in enumerate(self.words):
            c = shingle_codes(ws)
            codes.append(c), item.append(np.full(len(c), k)), pos.append(np.arange(len(c)))
        codes, item, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, item, pos))
        order = np.lexsort((pos, item, codes))
        self.codes, start = np.unique(codes[order], return_index=True)
        self.item, self.pos = item[order], pos[order]
        self.sizes = np.array([len(ws) for ws in self.words], np.int64)
        self.start = np.append(start, len(order))
        self.shared = np.array([texts_of[tuple(items[k][1][p : p + SHINGLE])] > SHARED for k, p in zip(self.item[start], self.pos[start])], bool)

    def prefixes(self, counts: np.ndarray, n_records: int) -> None:
        """Mark, per posting, whether it is evidence (rare) and whether it is in the item's prefix."""
        n = counts[np.repeat(np.arange(len(self.codes)), np.diff(self.start))]
        self.rare = ~np.repeat(self.shared, np.diff(self.start)) | (n <= RARE * n_records)
        self.prefix = np.zeros(len(n), bool)
        mine = np.flatnonzero(self.rare)
        mine = mine[np.lexsort((n[mine], self.item[mine]))]  # each item's postings by rarity
        size = np.bincount(self.item[mine], minlength=len(self.ids))
        rank = np.arange(len(mine)) - np.repeat(np.cumsum(size) - size, size)
        self.prefix[mine[rank <= size[self.item[mine]] - OVERLAP]] = True
        self.code_prefix, self.code_rare = (np.logical_or.reduceat(x, self.start[:-1]) if len(x) else x for x in (self.prefix, self.rare))


def shingle_codes(ws: np.ndarray) -> np.ndarray:
    n = len(ws) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    c = ws[:n].copy()
    for k in range(1, SHINGLE):
        c = c << _BITS | ws[k : n + k]
    return c


def _hits(block: ItemBlock, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Hits of known shingles in some texts: number of the text, word position, shingle number; all words and where each text's begin."""
    found: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            ws = WORD.findall(text.lower())
            sizes[k] = len(ws)
            found += ws
    n = len(found) - SHINGLE + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(len(texts) + 1, np.int64)
    ws = np.fromiter(map(block.vocabulary.get, found, repeat(0)), np.int64, len(found))
    rec = np.repeat(np.arange(len(texts)), sizes)
    ok = (ws[:n] > 0) & (rec[:n] == rec[SHINGLE - 1 :])
    for k in range(1, SHINGLE):
        ok &= ws[k : n + k] > 0
    at = np.flatnonzero(ok)
    c = ws[at]
    for k in range(1, SHINGLE):
        c = c << _BITS | ws[at + k]
    j = np.searchsorted(block.codes, c)
    j[j == len(block.codes)] = 0
    ok = block.codes[j] == c
    at, j = at[ok], j[ok]
    first = np.append(0, np.cumsum(sizes))
    return rec[at], at - first[rec[at]], j, ws, first


def _count(block: ItemBlock):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = len(block.codes)
        n = np.zeros(total + 1, np.int64)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rec, _, j, _, _ = _hits(block, texts)
            n[:-1] += np.bincount(np.unique(rec * total + j) % total, minlength=total)
            n[-1] += sum(map(bool, texts))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["shingle", "n"])

    return run


def _runs(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of equal words from shingle hits: record position, item position, words, shingles.

    Hits on one diagonal belong to one run while their shingles touch: the words between two rare
    shingles that overlap or adjoin are equal as well.
    """
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    cut = np.flatnonzero((np.diff(p - q) != 0) | (np.diff(p) > SHINGLE)) + 1
    return [(int(p[a]), int(q[a]), int(p[b - 1] - p[a]) + SHINGLE, int(b - a)) for a, b in zip([0, *cut], [*cut, len(p)])]


def _passages(runs: list[tuple[int, int, int, int]], text: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Runs grown over the equal words around them, across single changed words that two equal ones follow.

    Of each: record position, item position, span, rare shingles, equal words.
    """
    out: list[tuple[int, int, int, int, int]] = []
    for p, q, n, r in runs:  # by diagonal, then position
        floor = 0
        if out and out[-1][0] - out[-1][1] == p - q:
            floor = out[-1][0] + out[-1][2]
            if p < floor:
                out[-1] = (*out[-1][:3], out[-1][3] + r, out[-1][4])
                continue
        m = n
        while p > floor and q:
            if text[p - 1] == item[q - 1]:
                p, q, n, m = p - 1, q - 1, n + 1, m + 1
            elif p > floor + 2 and q > 2 and text[p - 2] == item[q - 2] and text[p - 3] == item[q - 3]:
                p, q, n, m = p - 3, q - 3, n + 3, m + 2
            else:
                break
        while (e := p + n) < len(text) and (f := q + n) < len(item):
            if text[e] == item[f]:
                n, m = n + 1, m + 1
            elif e + 2 < len(text) and f + 2 < len(item) and text[e + 1] == item[f + 1] and text[e + 2] == item[f + 2]:
                n, m = n + 3, m + 2
            else:
                break
        out.append((p, q, n, r, m))
    return out


def chain(runs: list[tuple[int, int, int, int, int]], reach: int, gap: float = inf, far: float = inf) -> tuple[int, int]:
    """Most words, and the rare shingles among them, of runs in the order of both texts.

    A run follows another within ``reach`` words of the record, at any distance if both have ``far``
    rare shingles, and within ``gap`` words of the item. Runs that overlap by a few words count only
    their new words.
    """
    runs = sorted(runs)
    best: list[tuple[int, int]] = []
    for i, (p, q, n, r, m) in enumerate(runs):
        top = (m, r)
        for k in range(i):
            pp, qq, nn, rr, _ = runs[k]
            over = max(0, pp + nn - p, qq + nn - q)
            if pp < p and (p <= pp + nn + reach or min(r, rr) >= far) and qq < q <= qq + nn + gap and over < m:
                w, e = best[k]
                top = max(top, (w + m - over, e + r))
        best.append(top)
    return max(best)


def _postings(start: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the postings of shingles ``j``, and for each the place in ``j`` it belongs to."""
    width = start[j + 1] - start[j]
    of = np.repeat(np.arange(len(j)), width)
    return np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width) + start[j][of], of


def _within_bounds(pair: np.ndarray, p: np.ndarray, q: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Hits (sorted by pair, then record position) that the length and the position bound leave."""
    if not len(pair):
        return np.zeros(0, bool)
    # Windows of a record: between two of them no passage follows another, unless both are long.
    window = np.append(0, np.cumsum((np.diff(pair) != 0) | (np.diff(p) > reach[1:] + SHINGLE)))
    alone = np.bincount(window)[window]
    keep = alone >= FAR
    # Shingles of an item that several of its places or the record's share count once.
    top = int(q.max()) + 1
    keys = np.unique(pair[keep] * top + q[keep]) // top
    have, n = np.unique(keys, return_counts=True)
    return keep & np.isin(pair, have[n >= OVERLAP])


def _match(block: ItemBlock):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(block.ids)
        for batch in batches:
            rec, at, j, ws, first_word = _hits(block, batch.column(2).to_pylist())
            # Prefix join: only records and items that meet in a prefix shingle are looked at.
            pre = block.code_prefix[j]
            k, of = _postings(block.start, j[pre])
            keys = np.unique((rec[pre][of] * m + block.item[k])[block.prefix[k]])
            near = block.code_rare[j] & np.isin(rec, keys // m)
            rec, at, j = rec[near], at[near], j[near]
            k, of = _postings(block.start, j)
            pair = rec[of] * m + block.item[k]
            rare = block.rare[k] & np.isin(pair, keys)
            pair, p, q = pair[rare], at[of][rare], block.pos[k][rare]
            order = np.lexsort((p, pair))
            pair, p, q = pair[order], p[order], q[order]
            keep = _within_bounds(pair, p, q, REACH * block.sizes[pair % m])
            pair, p, q = pair[keep], p[keep], q[keep]
            keys, first, size = np.unique(pair, return_index=True, return_counts=True)
            rec_id, item_id, n_words, n_rare = [], [], [], []
            for key, a, n in zip(keys.tolist(), first.tolist(), size.tolist()):
                x = key % m
                text = ws[first_word[key // m] : first_word[key // m + 1]]
                runs = _passages(_runs(p[a : a + n], q[a : a + n]), text, block.words[x])
                reach = REACH * len(block.words[x])
                words, evidence = chain(runs, reach, far=FAR)
                if words >= LEAST_WORDS and evidence < PLAIN:
                    words, evidence = chain(runs, reach, 1, FAR)
                if words >= LEAST_WORDS and evidence >= OVERLAP:
                    rec_id.append(key // m), item_id.append(block.ids[x]), n_words.append(words), n_rare.append(evidence)
            rows = pa.array(rec_id, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(item_id, pa.int64()), pa.array(n_words, pa.int32()), pa.array(n_rare, pa.int32())], names=["tbl", "rec_id", "item_id", "n_words", "n_rare"]
            )

    return run


def item_blocks(items: list[tuple[int, str]]) -> list[ItemBlock]:
    words = [(i, ws) for i, text in items if len(ws := WORD.findall(text.lower())) >= LEAST_WORDS]
    texts_of = Counter(g for ws in {tuple(ws) for _, ws in words} for g in {ws[k : k + SHINGLE] for k in range(len(ws) - SHINGLE + 1)})
    blocks, now, seen, n = [], [], set(), 0
    for i, ws in words:
        if now and (len(seen) + len(ws) > BLOCK_WORDS or n + len(ws) > BLOCK_SHINGLES):
            blocks.append(ItemBlock(now, texts_of))
            now, seen, n = [], set(), 0
        now.append((i, ws))
        seen.update(ws)
        n += len(ws)
    return [*blocks, *([ItemBlock(now, texts_of)] if now else [])]


def leaks(records: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``tbl, rec_id, item_id, n_words, n_rare`` of every leak.

    ``records``: ``tbl, rec_id, text``. The benchmark is a held-out set, read whole and in blocks.
    """
    spark = records.sparkSession
    items = [(r[0], r[1]) for r in benchmark.where(f"{item_col} is not null and {item_text} is not null").select(item_col, item_text).distinct().orderBy(item_col).collect()]
    schema = "tbl string, rec_id bigint, item_id bigint, n_words int, n_rare int"
    out = spark.createDataFrame([], schema)
    src = spread(records.select("tbl", F.col("rec_id").cast("bigint").alias("rec_id"), "text").where("text is not null"))
    for block in item_blocks(items):
        counted = src.mapInArrow(_count(block), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).collect()  # bounded by the block
        n = np.zeros(len(block.codes) + 1, np.int64)
        for r in counted:
            n[r["shingle"]] = r["n"]
        block.prefixes(n[:-1], int(n[-1]))
        out = out.unionByName(src.mapInArrow(_match(block), schema))
    return out.distinct()
