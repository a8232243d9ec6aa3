"""Exact and near deduplication, and the cap per problem.

Order matters in all three: input rows carry ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.config import CONTEST_SOURCE, DEFAULT, Thresholds
from lodewright.functions.hashing import estimated_jaccard, group_keys, minhash, position_bits, position_groups
from lodewright.operators.base import checkpoint, spread

SETTLED_AT_ONCE = 500_000  # open edges of two ids each that one task settles


def exact_removed(df: DataFrame, key: str = "normalized_hash", order: Column | None = None, pin: bool = True) -> DataFrame:
    """``doc_id, source_id, duplicate_of, o`` of every row that is not the first of its hash; needs no text.

    ``pin`` writes ids and hashes down first, so that the hash of a text is computed once for both uses.

    The first per hash is an aggregate with map-side combining, so a hash with very many copies does
    not gather in one task before it is reduced; rows of a null hash are no duplicates of each other.
    """
    order = F.col("ord") if order is None else order
    slim = df.select("doc_id", "source_id", F.col(key).alias("h"), order.alias("o")).where("h is not null")
    slim = checkpoint(slim) if pin else slim
    first = slim.groupBy("h").agg(F.min(F.struct("o", "doc_id")).alias("first"))
    return slim.join(first, "h").where(F.struct("o", "doc_id") != F.col("first")).select("doc_id", "source_id", F.col("first.doc_id").alias("duplicate_of"), "o")


def exact_dedup(df: DataFrame, key: str = "normalized_hash", order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """First row of each hash survives, the others name it in ``duplicate_of``.

    Rows are told apart by id and order together, so rows that share an id do not take each other away. The rows kept
    are joined once with the losers; the pipeline decides on ids alone and joins texts only at its end.
    """
    lost = exact_removed(df, key, order)
    removed = lost.select("doc_id", "source_id", F.lit("exact_dedup").alias("stage"), F.array(F.lit("exact_duplicate")).alias("reason_codes"), "duplicate_of")
    at = (F.col("ord") if order is None else order).alias("_o")
    kept = df.withColumn("_o", at).join(lost.select("doc_id", F.col("o").alias("_o")), ["doc_id", "_o"], "left_anti")
    return kept.select(*df.columns), removed


def with_signature(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """``k, sig``: order key and signature of each document."""
    return spread(df.select("source_id", "doc_id", "text")).select(F.struct("source_id", "doc_id").alias("k"), minhash(F.col("text"), t.permutations, t.shingle).alias("sig"))


def with_copies(df: DataFrame, t: Thresholds = DEFAULT, key: str = "normalized_hash") -> DataFrame:
    """``n, k, o, h, sig`` of each document, written down: near dedup of these drops copies of a text (later rows of a hash) first.

    One pass over the texts, which are not shuffled to find the copies. The price: copies get a signature too.
    """
    h = F.coalesce(F.unhex(F.col(key)), F.col(key).cast("binary"))
    d = spread(df.select("source_id", "doc_id", "ord", key, "text"))
    return checkpoint(d.select(F.monotonically_increasing_id().alias("n"), F.struct("source_id", "doc_id").alias("k"), F.col("ord").alias("o"), h.alias("h"), minhash(F.col("text"), t.permutations, t.shingle).alias("sig")))


@dataclass(frozen=True)
class Signed:
    """Signatures are written once and not shuffled as a whole: what needs few of them picks them by marks, one bit a row."""

    rows: DataFrame  # n, k, sig: all documents, written down
    copies: DataFrame  # k, rep: documents whose signature an earlier one (by source, id) has
    firsts: DataFrame  # marks of the first document of each signature


def signatures(sigs: DataFrame) -> Signed:
    """From ``k, sig``, or from ``with_copies``."""
    rows = sigs if "n" in sigs.columns else checkpoint(sigs.select(F.monotonically_increasing_id().alias("n"), "k", "sig"))
    slim = rows.select(*[c for c in rows.columns if c != "sig"], F.xxhash64("sig").alias("h1"), F.xxhash64(F.lit(1), "sig").alias("h2"))
    # Both aggregates combine on the map side, so a text or signature that a large share of documents has stays small.
    if "h" in rows.columns:
        first = slim.groupBy("h", F.when(F.col("h").isNull(), F.col("n"))).agg(F.min(F.struct("o", "k.doc_id", "n", "k")).alias("first"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
        slim = first.select("first.n", "first.k", "h1", "h2")
    slim = checkpoint(slim)
    first = slim.groupBy("h1", "h2").agg(F.min(F.struct("k", "n")).alias("first"))
    copies = slim.join(first, ["h1", "h2"]).where((F.col("n") != F.col("first.n")) & (F.col("k") != F.col("first.k"))).select("k", F.col("first.k").alias("rep"))
    return Signed(rows.select("n", "k", "sig"), copies, _marks(first.select("first.n")))


def _marks(rows: DataFrame) -> DataFrame:
    """``bucket, bits``: a bit for each ``n`` of ``rows``; what is sent around is an eighth of a byte per document."""
    return checkpoint(rows.groupBy(F.expr("bitmap_bucket_number(n + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(n + 1))").alias("bits")))


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``n`` is marked, without a shuffle."""
    byte = "cast(conv(hex(substring(bits, cast(bitmap_bit_position(n + 1) div 8 as int) + 1, 1)), 16, 10) as int)"
    found = rows.join(F.broadcast(marks), F.expr("bitmap_bucket_number(n + 1) = bucket"))
    return found.where(f"bit_get({byte}, cast(bitmap_bit_position(n + 1) % 8 as int)) = 1").select(*rows.columns)


_KEYED = "key bigint, n bigint, bits0 bigint, bits1 bigint"
_FOUND = "x bigint, y bigint, key bigint"


def near_edges(df: DataFrame | None, t: Thresholds = DEFAULT, sigs: Signed | None = None, hot: int = 1_000) -> DataFrame:
    """Pairs ``a, b`` (``b`` before ``a`` in order of source and id) of estimated similarity of at least the cutoff.

    Only documents that are the first of their signature are paired: documents of equal signature have equal
    neighbours. ``band`` is the first band a pair shares. At the cutoff ``most`` positions may differ, so of ``most + 1`` groups
    of positions a pair shares one, and no pair is missed; below a cutoff of 1 - (bands - 1) / permutations the groups are the bands
    themselves. Each document sends one row a group: key, number and one bit a position, by which most pairs that differ too much
    are dropped before anything is joined. A group that more than ``hot`` documents share is split by groups of the other
    positions: a template that gives very many documents one key costs no square of them. Signatures are shuffled only of
    documents that are left in a pair.
    """
    sigs = signatures(with_signature(df, t)) if sigs is None else sigs
    n_bands, most = t.permutations // t.band_size, int((1 - t.near_cutoff) * t.permutations + 1e-9)
    forced = most < n_bands
    groups = position_groups(list(range(t.permutations)), most + 1) if forced else [list(range(i * t.band_size, (i + 1) * t.band_size)) for i in range(n_bands)]
    slim = sigs.rows.select("n", "sig")
    keyed = _marked(slim, sigs.firsts).mapInArrow(_keyed(t.permutations, groups), _KEYED)
    found = checkpoint(keyed.repartition("key").mapInArrow(_paired(most, hot if forced else None), _FOUND))
    pairs, crowd = found.where("y is not null").select("x", "y"), found.where("y is null")
    if crowd.take(1):
        # At most documents x groups / hot keys.
        many = np.sort(np.array([r["key"] for r in crowd.select("key").distinct().collect()], np.int64).view(np.uint64))
        sent = crowd.sparkSession.sparkContext.broadcast(many)
        split = _marked(slim, _marks(crowd.select(F.col("x").alias("n")))).mapInArrow(_split(t.permutations, groups, most + 1, sent), _KEYED)
        pairs = pairs.unionByName(split.repartition("key").mapInArrow(_paired(most, None), _FOUND).select("x", "y"))
    pairs = checkpoint(pairs.distinct())
    few = _marked(sigs.rows, _marks(pairs.select(F.col("x").alias("n")).unionByName(pairs.select(F.col("y").alias("n")))))
    both = pairs.join(few.select(F.col("n").alias("x"), F.col("k").alias("kx"), F.col("sig").alias("sx")), "x").join(few.select(F.col("n").alias("y"), F.col("k").alias("ky"), F.col("sig").alias("sy")), "y")
    near = both.withColumn("similarity", estimated_jaccard(F.col("sx"), F.col("sy"))).where((F.col("similarity") >= t.near_cutoff) & (F.col("kx") != F.col("ky")))
    # The first band in which all positions are equal.
    same = F.zip_with("sx", "sy", lambda x, y: x == y)
    whole = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.forall(F.slice(same, i * t.band_size + 1, t.band_size), lambda x: x))
    return near.select(F.greatest("kx", "ky").alias("a"), F.least("kx", "ky").alias("b"), (F.array_position(whole, F.lit(True)) - 1).cast("int").alias("band"), "similarity")


def _rows_of(batch: pa.RecordBatch, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    n, sig = batch.column("n").to_numpy(), batch.column("sig").flatten().to_numpy()
    return n, sig.view(np.uint64).reshape(len(n), permutations)


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=names)


def _keyed(permutations: int, groups: list[list[int]]):
    """One row per document and group of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig = _rows_of(batch, permutations)
            yield _batch(["key", "n", "bits0", "bits1"], group_keys(sig, groups).T.ravel(), *[np.tile(c, len(groups)) for c in (n, *position_bits(sig))])

    return run


def _split(permutations: int, groups: list[list[int]], parts: int, many):
    """Rows of crowded keys again, one per group of the positions outside the key's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig = _rows_of(batch, permutations)
            keys, bits = group_keys(sig, groups), position_bits(sig)
            for g, own in enumerate(groups):
                at = np.flatnonzero(np.isin(keys[:, g], many.value))
                rest = sorted(set(range(permutations)) - set(own))
                inner = position_groups(rest, parts) if len(rest) >= parts else [[]]
                if len(at):
                    yield _batch(["key", "n", "bits0", "bits1"], group_keys(sig[at], inner, keys[at, g]).T.ravel(), *[np.tile(c[at], len(inner)) for c in (n, *bits)])

    return run


def _paired(most: int, hot: int | None):
    """From the rows of whole keys: pairs ``x < y`` whose bits differ in at most ``most`` positions; of a key of more than ``hot`` rows its rows, with ``y`` null."""
    names = ["x", "y", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not read:
            return
        key, n, bits0, bits1 = (np.concatenate([r[i] for r in read]) for i in range(4))
        del read
        order = np.argsort(key)
        key = key[order]
        size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
        size = np.repeat(size, size)
        if hot is not None and (crowd := size > hot).any():
            yield pa.RecordBatch.from_arrays([pa.array(n[order[crowd]]), pa.nulls(int(crowd.sum()), pa.int64()), pa.array(key[crowd])], names=names)
        keep = (size > 1) if hot is None else (size > 1) & (size <= hot)
        key, order = key[keep], order[keep]
        n, bits0, bits1 = n[order], bits0[order].view(np.uint64), bits1[order].view(np.uint64)  # counted unsigned: of a negative number numpy counts the bits of its absolute value
        left, step, out, held = np.arange(len(key)), 0, [], 0
        while len(left):
            step += 1
            left = left[: np.searchsorted(left, len(key) - step)]
            left = left[key[left] == key[left + step]]
            for part in np.array_split(left, len(left) // 1_000_000 + 1):
                apart = np.bitwise_count(bits0[part] ^ bits0[part + step]) + np.bitwise_count(bits1[part] ^ bits1[part + step])
                close = part[apart <= most]
                x, y = n[close], n[close + step]
                out.append((np.minimum(x, y), np.maximum(x, y), key[close]))
                held += len(close)
                if held > 50_000:
                    yield _batch(names, *[np.concatenate(c) for c in zip(*out)])
                    out, held = [], 0
        if held:
            yield _batch(names, *[np.concatenate(c) for c in zip(*out)])

    return run


def near_removed(sigs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """``doc_id, source_id, duplicate_of`` of every document that goes, from ``k, sig`` or ``with_copies``; needs no text.

    Greedy in order of source and id: a row goes if it is similar to an earlier row that stays. Solved over the
    (sparse) edges between first documents of a signature, in rounds: rows whose earlier neighbours have all gone
    stay, rows with an earlier neighbour that stays go. Few open edges are settled at once in one bounded task; rounds
    go on while there are many. Later documents of a signature always go. ``duplicate_of`` is the
    earlier kept neighbour of the first shared band, then the first in order.
    """
    sigs = signatures(sigs)
    edges, copies = checkpoint(near_edges(None, t, sigs)), checkpoint(sigs.copies)
    kind = sigs.rows.schema["k"].dataType.simpleString()
    open_edges, gone = edges.select("a", "b"), None
    while open_edges.count() > SETTLED_AT_ONCE:
        # b is settled to stay if it has no open earlier neighbour itself.
        stays = open_edges.select(F.col("b").alias("k")).distinct().join(open_edges.select(F.col("a").alias("k")).distinct(), "k", "left_anti")
        out = checkpoint(open_edges.join(stays.withColumnRenamed("k", "b"), "b", "left_semi").select(F.col("a").alias("k")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        rest = open_edges.join(out.withColumnRenamed("k", "a"), "a", "left_anti").join(out.withColumnRenamed("k", "b"), "b", "left_anti")
        open_edges = checkpoint(rest)
    flat = open_edges.select("a.source_id", "a.doc_id", F.col("b.source_id").alias("source_b"), F.col("b.doc_id").alias("doc_b"), F.lit(0).alias("one"))
    last = flat.groupBy("one").applyInPandas(_settle, sigs.rows.select("k.source_id", "k.doc_id").schema).select(F.struct("source_id", "doc_id").cast(kind).alias("k"))
    gone = checkpoint(last if gone is None else gone.unionByName(last))
    # Kept neighbours of a signature, in either direction, and its own first document if that stays.
    near = edges.select(F.col("a").alias("rep"), F.col("b").alias("other"), "band").union(edges.select("b", "a", "band"))
    own = copies.select("rep", F.col("rep").alias("other"), F.lit(0).alias("band")).distinct()
    near = near.unionByName(own).join(gone.withColumnRenamed("k", "other"), "other", "left_anti")
    lost = copies.unionByName(gone.select("k", F.col("k").alias("rep")))
    named = lost.join(near, "rep").where(F.col("other") < F.col("k")).groupBy("k").agg(F.min_by("other", F.struct("band", "other")).alias("b"))
    return named.select("k.doc_id", "k.source_id", F.col("b.doc_id").alias("duplicate_of"))


def _settle(edges: pd.DataFrame) -> pd.DataFrame:
    """The greedy rule over a bounded number of edges, in order (that of UTF-8 bytes, as in the JVM)."""
    key = lambda *k: tuple(b"" if v is None else b"\x01" + v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v for v in k)
    earlier: dict[tuple, list[tuple]] = {}
    names: dict[tuple, tuple] = {}
    for sa, da, sb, db in zip(edges["source_id"], edges["doc_id"], edges["source_b"], edges["doc_b"]):
        a = key(sa, da)
        names[a] = (sa, da)
        earlier.setdefault(a, []).append(key(sb, db))
    gone: set[tuple] = set()
    for k in sorted(earlier):
        if any(b not in gone for b in earlier[k]):
            gone.add(k)
    return pd.DataFrame([names[k] for k in gone], columns=["source_id", "doc_id"])


def near_dedup(df: DataFrame, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)`` of ``near_removed``; ids are unique (exact deduplication comes first)."""
    lost = near_removed(with_signature(df, t), t)
    removed = lost.select("doc_id", "source_id", F.lit("near_dedup").alias("stage"), F.array(F.lit("near_duplicate")).alias("reason_codes"), "duplicate_of")
    return df.join(removed.select("doc_id"), "doc_id", "left_anti").select(*df.columns), removed


def problem_rank(df: DataFrame, order: tuple[str, ...] = ("normalized_hash", "ord")) -> DataFrame:
    """Rows of a problem with ``_rn``, their rank in it. A filter above it becomes a group limit, which prunes before the shuffle."""
    return df.where(F.col("problem_id") != "").withColumn("_rn", F.row_number().over(Window.partitionBy("problem_id").orderBy(*order)))


def problem_cap(df: DataFrame, cap: int = 8, order: tuple[str, ...] = ("normalized_hash", "ord")) -> tuple[DataFrame, DataFrame]:
    """Keep ``cap`` rows per problem by hash; rows without a problem are not capped.

    A rank filter above ``row_number`` becomes a group limit, which prunes before the shuffle, so a problem with a
    large share of all rows sends ``cap`` rows per task.
    """
    has = F.coalesce(F.col("problem_id") != "", F.lit(False))
    kept_ids = problem_rank(df.select("doc_id", "problem_id", *order), order).where(F.col("_rn") <= cap).select("doc_id", *order)
    # Rows are told apart by id and order; null hashes count as equal.
    named = kept_ids.select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in order])
    on = (F.col("doc_id") == F.col("_id")) & (F.col(order[0]).eqNullSafe(F.col(f"_{order[0]}")))
    for c in order[1:]:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    kept = df.where(~has).unionByName(df.where(has).join(named, on, "left_semi"))
    removed = df.where(has).join(named, on, "left_anti").select("doc_id", "source_id", F.lit("problem_cap").alias("stage"), F.array(F.lit("problem_cap")).alias("reason_codes"), "problem_id")
    return kept, removed


def contest_order(df: DataFrame) -> DataFrame:
    """Replace ``ord`` by the pipeline's order: other rows, contest rows without a problem, then contest rows by first row of their problem, hash and input order.

    The result is a sortable struct, not a number: a global number would take one task.
    """
    contest = (F.col("source_id") == CONTEST_SOURCE).cast("int")
    pid = F.when(F.col("problem_id") != "", F.col("problem_id"))
    first = df.where((F.col("source_id") == CONTEST_SOURCE) & pid.isNotNull()).groupBy("problem_id").agg(F.min("ord").alias("_first"))
    both = df.join(first, "problem_id", "left")
    grouped = (contest == 1) & pid.isNotNull()
    key = F.struct(
        contest.alias("c"), grouped.cast("int").alias("p"), F.coalesce(F.when(grouped, F.col("_first")), F.lit(0)).alias("f"), F.when(grouped, F.col("normalized_hash")).otherwise("").alias("h"), F.col("ord").alias("o")
    )
    return both.withColumn("ord", key).select(*df.columns)
