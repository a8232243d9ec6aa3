"""Problem 2: near-duplicate texts, at a Jaccard similarity of character 5-grams.

1. Texts are normalised; equal normalised texts form a class, one of its documents represents it.
2. A representative gets a MinHash sketch (one hash round fills many cells, empty cells borrow) and from
   it a fingerprint of 256 bits, one bit per cell.
3. Candidate pairs share a band of the sketch. (Pivots only discard pairs, they cannot propose them.) A band
   of very many documents is split by classes of size, between which no pair reaches the similarity. On
   request candidates come from a prefix-filtered join on rare grams instead, which misses none.
4. Pivot table: each fingerprint's Hamming distances to reference fingerprints, spread over the
   fingerprints of a bounded sample of documents, travel with the bands. By the triangle inequality a
   pair whose coordinates differ by more than the radius anywhere is farther apart than the radius and
   is dropped; so are pairs whose sizes exclude the similarity. (No tighter bound is safe: where a pivot
   is near one of the pair, the difference is the whole distance.)
5. Survivors are held against the radius on the fingerprints, then verified on the whole texts, exactly.
   In texts of fewer grams than cells, cells borrow from each other and bits go together, so the radius
   would lose pairs: where one of a pair has fewer, neither pivots nor fingerprints are asked.

Defined results: texts without a 5-gram (null, empty, fewer than five characters after normalising)
have no similar text. Repeated rows are copies of one class. Pairs of documents come out once, lower
id first; documents of null id are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.llm.common import NOT_ALNUM, reliable, spread

GRAM = 5
CELLS, ROUNDS = 96, 3  # 288 sketch values
BAND_ROWS = 6  # 48 bands: a pair at 0.7 is missed with 0.25 %, at 0.75 with 0.01 %, at 0.8 with 4e-7
BITS = 256
PIVOTS = 8
MAX_BROADCAST_IDS = 1_000_000
HOT_BAND = 2_000  # documents of a band that is joined as it is
PIVOT_SAMPLE = 2_000  # fingerprints of which the pivots are chosen
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def normal(text: str) -> str:
    return NOT_ALNUM.sub(" ", text.lower()).strip()


def radius(similarity: float) -> int:
    """Hamming radius of the fingerprints: mean distance at the similarity plus four deviations."""
    p = (1 - similarity) / 2
    return int(np.ceil(BITS * p + 4 * np.sqrt(BITS * p * (1 - p))))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the runs of GRAM characters, in text order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(c) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = c[:n].copy()
    for k in range(1, GRAM):
        h *= np.uint64(0x100000001B3)
        h ^= c[k : n + k]
        if k % 2:
            h ^= h >> np.uint64(31)
    return _mix(h)


def sketch(h: np.ndarray) -> np.ndarray:
    """CELLS * ROUNDS minima of a set of hashes."""
    out = np.empty((ROUNDS, CELLS), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for r in range(ROUNDS):
        x = h * _MUL[r]
        x ^= x >> np.uint64(32)
        cell = ((x >> np.uint64(40)) * np.uint64(CELLS)) >> np.uint64(24)
        value = x * np.uint64(0xD6E8FEB86659FD93)
        row = np.full(CELLS, top)
        np.minimum.at(row, cell.astype(np.intp), value)
        empty = np.flatnonzero(row == top)
        if len(empty):
            full = np.flatnonzero(row != top)
            # An empty cell borrows from a full one that a hash of cell and attempt picks first.
            tries = _PROBES[r][empty]
            hit = np.isin(tries, full)
            pick = tries[np.arange(len(empty)), hit.argmax(1)]
            pick = np.where(hit.any(1), pick, full[0])
            row[empty] = row[pick] + (empty + 1).astype(np.uint64) * _MUL[1]
        out[r] = row
    return out.ravel()


_PROBES = [np.array([[(int(_MUL[0]) * (c * 977 + t * 131 + r * 7919 + 1) >> 40) % CELLS for t in range(96)] for c in range(CELLS)]) for r in range(ROUNDS)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, size, bands, prints = [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = normal(text)
            if len(t) < GRAM:
                continue
            h = gram_hashes(t)
            s = sketch(h)
            ids.append(i)
            keys.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
            size.append(len(np.unique(h)))
            key = s.reshape(-1, BAND_ROWS)
            k = key[:, 0] + np.arange(len(key), dtype=np.uint64)
            for c in range(1, BAND_ROWS):
                k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + key[:, c]
            bands.append(_mix(k).view(np.int64))
            prints.append(np.packbits((s[:BITS] >> np.uint64(17)).astype(np.uint8) & 1).tobytes())
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, CELLS * ROUNDS // BAND_ROWS, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(size, pa.int32()), lists, pa.array(prints, pa.binary())], names=["doc_id", "k", "size", "bands", "fp"])


def _distances(pivots: np.ndarray):
    """Pivot coordinates of fingerprints, one byte each, eight in a long."""
    width = (len(pivots) + 7) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            fp = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(n, BITS // 8)
            d = np.zeros((n, width * 8), np.uint8)
            for j, p in enumerate(pivots):
                d[:, j] = np.minimum(np.bitwise_count(fp ^ p).sum(1, dtype=np.int32), 255)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(d.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["doc_id", "size", "bands", "pivots"])

    return run


def choose_pivots(prints: list[bytes], count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints far from each other (farthest first) among a sample."""
    fp = np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), BITS // 8)
    chosen = [0]
    near = np.bitwise_count(fp ^ fp[0]).sum(1, dtype=np.int32)
    while len(chosen) < min(count, len(fp)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.bitwise_count(fp ^ fp[chosen[-1]]).sum(1, dtype=np.int32))
    return fp[chosen]


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep, sims = batch.column(0), batch.column(1), [], []
            held: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if held[0] != x:
                    held = (x, np.unique(gram_hashes(normal(x))))
                h, g = held[1], np.unique(gram_hashes(normal(y)))
                both = len(np.intersect1d(h, g, assume_unique=True))
                s = both / max(1, len(h) + len(g) - both)
                keep.append(s >= similarity)
                sims.append(s)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask), pa.array(sims, pa.float64()).filter(mask)], names=["a", "b", "similarity"])

    return run


def _prefix_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` that may reach the similarity, none missed: prefix-filtered join on grams in order of rarity.

    Two sets of that similarity share one of the rarest n - ceil(similarity * n) + 1 grams of each.
    """
    grams = reliable(texts.mapInArrow(_grams, "doc_id bigint, size int, grams array<bigint>"))
    each = grams.select("doc_id", "size", F.explode("grams").alias("g"))
    seen = each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")  # a gram of one text pairs nothing, but counts in the prefix
    ranked = each.join(seen, "g", "left").select("doc_id", "size", F.struct(F.coalesce("n", F.lit(1)).alias("n"), "g").alias("x"))
    sets = ranked.groupBy("doc_id", "size").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    prefix = F.slice("xs", F.lit(1), (F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1).cast("int"))
    rows = reliable(sets.select("doc_id", "size", F.explode(F.filter(prefix, lambda x: x["n"] > 1)).alias("x")).select("doc_id", "size", F.col("x.g").alias("g")))
    left, right = (rows.select("g", F.col("doc_id").alias(c), F.col("size").alias(f"s{c}")) for c in "ab")
    return left.join(right, "g").where((F.col("a") < F.col("b")) & (F.col("sa") >= similarity * F.col("sb")) & (F.col("sb") >= similarity * F.col("sa"))).select("a", "b").distinct()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(gram_hashes(normal(t))).view(np.int64) for t in batch.column(1).to_pylist()]
        size = np.array([len(x) for x in sets], np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), lists], names=["doc_id", "size", "grams"])


def _met(left: DataFrame, right: DataFrame, on: list[str], near: Column) -> DataFrame:
    return left.join(right, on).where(near).select("a", "b")


def similar_classes(documents: DataFrame, similarity: float = 0.7, *, id_col: str = "doc_id", text_col: str = "text", exact: bool = False, pivots: int = PIVOTS, hot: int = HOT_BAND) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``.

    pairs: ``a, b, similarity`` of similar class representatives, a < b. members: ``rep, doc_id`` of every
    document with a 5-gram. ``exact`` finds candidates by a join on rare grams that misses no pair, at the cost of
    shuffling all grams.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    sk = reliable(spread(docs).mapInArrow(_sketches, "doc_id bigint, k binary, size int, bands array<bigint>, fp binary"))
    first = sk.groupBy("k").agg(F.min("doc_id").alias("rep"))
    members = sk.select("k", "doc_id").join(first, "k").select("rep", "doc_id")
    reps = sk.join(first, (sk["k"] == first["k"]) & (sk["doc_id"] == first["rep"]), "left_semi").select("doc_id", "size", "bands", "fp")
    if exact:
        pairs = _prefix_pairs(docs.join(reps.select("doc_id").distinct(), "doc_id", "left_semi"), similarity)
        return _verified(docs, reliable(pairs), similarity), members
    sample = [bytes(r["fp"]) for r in sk.orderBy(F.xxhash64("doc_id"), "doc_id").select("fp").limit(PIVOT_SAMPLE).collect()]
    if not sample:
        return documents.sparkSession.createDataFrame([], "a bigint, b bigint, similarity double"), members
    chosen = choose_pivots(sample, pivots)
    table = reps.mapInArrow(_distances(chosen), "doc_id bigint, size int, bands array<bigint>, pivots array<bigint>")
    banded = table.select("doc_id", "size", "pivots", F.explode("bands").alias("band"))
    size_class = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(similarity))).alias("class")
    left = banded.select("band", F.col("doc_id").alias("a"), F.col("size").alias("sa"), F.col("pivots").alias("pa"))
    right = banded.select("band", F.col("doc_id").alias("b"), F.col("size").alias("sb"), F.col("pivots").alias("pb"))
    near = (F.col("a") < F.col("b")) & (F.col("sa") >= similarity * F.col("sb")) & (F.col("sb") >= similarity * F.col("sa"))
    r = radius(similarity)
    few = F.least("sa", "sb") < CELLS
    close = F.lit(True)
    for j in range(len(chosen)):
        x, y = (F.shiftrightunsigned(F.col(c)[j // 8], 8 * (j % 8)).bitwiseAND(F.lit(255)) for c in ("pa", "pb"))
        close = close & (F.abs(x - y) <= r)
    near = near & (few | close)
    # A crowded band is split by size: similar sizes are in the same class or in neighbouring ones.
    crowded = reliable(reps.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("band"))
    if crowded.take(1):
        many = banded.join(crowded, "band", "left_semi").select("*", size_class)
        one = many.select("band", "class", F.col("doc_id").alias("a"), F.col("size").alias("sa"), F.col("pivots").alias("pa"))
        other = many.select("band", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"), F.col("doc_id").alias("b"), F.col("size").alias("sb"), F.col("pivots").alias("pb"))
        calm = _met(left.join(crowded, "band", "left_anti"), right.join(crowded, "band", "left_anti"), ["band"], near)
        pairs = calm.unionByName(_met(one, other, ["band", "class"], near)).distinct()
    else:
        pairs = _met(left, right, ["band"], near).distinct()
    # Survivors are held against the radius on the fingerprints themselves before any text is fetched.
    words = [F.conv(F.hex(F.substring("fp", 8 * i + 1, 8)), 16, -10).cast("bigint") for i in range(BITS // 64)]
    prints = reps.select("doc_id", "size", F.array(*words).alias("w"))
    pairs = pairs.join(prints.select(F.col("doc_id").alias("a"), F.col("size").alias("sa"), F.col("w").alias("wa")), "a").join(prints.select(F.col("doc_id").alias("b"), F.col("size").alias("sb"), F.col("w").alias("wb")), "b")
    apart = sum((F.bit_count(F.col("wa")[i].bitwiseXOR(F.col("wb")[i])) for i in range(BITS // 64)), F.lit(0))
    pairs = reliable(pairs.where(few | (apart <= r)).select("a", "b"))
    return _verified(docs, pairs, similarity), members


def _verified(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``a, b, similarity`` of the pairs that reach it, on the whole texts."""
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    need = reliable(need)
    # Ids of the documents to verify: sent to all executors while they are few, else joined.
    texts = docs.join(F.broadcast(need) if need.count() <= MAX_BROADCAST_IDS else need, "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    checked = both.select("a", "b", "ta", "tb").mapInArrow(_verify(similarity), "a bigint, b bigint, similarity double")
    return checked.distinct()


def near_duplicates(documents: DataFrame, same: DataFrame, similarity: float = 0.7) -> DataFrame:
    """``doc_id_a, doc_id_b``: all similar pairs of documents but those that are the same text.

    ``same``: ``first_doc_id, doc_id`` classes of equal texts (problem 5). Copies of a class are all
    listed, as the result is defined on documents; the similarity itself is computed once per class.
    """
    pairs, members = similar_classes(documents, similarity)
    m = members.join(same.select("first_doc_id", "doc_id"), "doc_id", "left").select("rep", "doc_id", F.coalesce("first_doc_id", "doc_id").alias("same"))
    a = m.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"), F.col("same").alias("xs"))
    b = m.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"), F.col("same").alias("ys"))
    out = pairs.join(a, "a").join(b, "b").where("xs <> ys")
    return out.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def groups(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``doc_id, class_id, n_links``: one row per document, its group and its number of similar texts.

    Groups are connected components over class representatives, found by alternating minima over
    neighbours and roots (each round at least halves a chain's pointers).
    """
    pairs, members = similar_classes(documents, similarity)
    pairs = reliable(pairs.select("a", "b"))
    edges = reliable(pairs.union(pairs.select("b", "a")).toDF("x", "y"))
    links = edges.groupBy("x").agg(F.count("*").alias("n_links"))
    root = reliable(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")))
    while True:
        seen = edges.join(root.select(F.col("x").alias("y"), F.col("root").alias("over")), "y").groupBy("x").agg(F.min("over").alias("over"))
        step = root.join(seen, "x").select("x", F.least("root", "over").alias("new"), "root")
        jump = root.select(F.col("x").alias("new"), F.col("root").alias("next"))
        step = reliable(step.join(jump, "new", "left").select("x", F.least("new", "next").alias("new"), "root"))
        moved = step.where("new <> root").take(1)
        root = step.select("x", F.col("new").alias("root"))
        if not moved:
            break
    found = root.join(links, "x").select(F.col("x").alias("rep"), "root", "n_links")
    return members.join(found, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
