"""Next-fit packing into fixed-length sequences, shards, holdout splits and checks.

Next fit is a fold over the documents in order. It is run in parallel over blocks of consecutive
documents: a block's effect depends only on how full the open sequence is when the block begins, and
documents of different starting fill soon agree (after the first overflow they share all later cuts that
coincide). Each block reports its table from starting fill to (new sequences, final fill). Tables of consecutive
blocks are composed, in groups, level by level, until few are left; the starts then go down the same levels, which
gives every block its true start, and the blocks place their documents independently. All of it runs on the
executors. The result is exactly that of one sequential pass.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.config import DEFAULT
from lodewright.operators.base import checkpoint, ordered_blocks

EOS, PAD = 3, 0


def with_eos(ids: Column, n_ctx: int) -> Column:
    """Token ids as they are packed: an end mark unless empty or already there; cut to ``n_ctx`` with an end mark."""
    ended = F.when((F.size(ids) == 0) | (F.element_at(ids, -1) == EOS), ids).otherwise(F.concat(ids, F.array(F.lit(EOS))))
    return F.when(F.size(ended) > n_ctx, F.concat(F.slice(ended, 1, n_ctx - 1), F.array(F.lit(EOS)))).otherwise(ended)


def block_table(lengths: list[int], n_ctx: int) -> list[tuple[int, int, int]]:
    """``(least starting fill, sequences closed, final fill)`` by ranges of the starting fill.

    Starting fills that first overflow at the same document share everything from there on, and there
    are only as many such documents as fit in one sequence. A fill that never overflows closes nothing, its
    entry holds the sum of the lengths.
    """
    memo: dict[int, tuple[int, int]] = {}

    def opened(i: int) -> tuple[int, int]:
        """Sequences opened from document ``i``, which opens one, to the end, and the final fill."""
        path = []
        while i not in memo:
            fill, j = 0, i
            while j < len(lengths) and fill + lengths[j] <= n_ctx:
                fill += lengths[j]
                j += 1
            if j == len(lengths):
                memo[i] = (1, fill)
                break
            path.append(i)
            i = j
        for k in reversed(path):
            memo[k] = (memo[i][0] + 1, memo[i][1])
            i = k
        return memo[i]

    rows, total, above = [], 0, n_ctx + 1
    for i, n in enumerate(lengths):
        total += n
        least = max(0, n_ctx - total + 1)
        if least < above:
            rows.append((least, *opened(i)))
            above = least
        if not above:
            break
    return sorted(rows + ([(0, 0, total)] if above else []))


def apply_table(table: list[tuple[int, int, int]], fill: int) -> tuple[int, int]:
    """Sequences closed and fill after a block that starts at ``fill``."""
    e, closed, last = table[bisect.bisect_right([r[0] for r in table], fill) - 1]
    return closed, (fill + last if closed == 0 else last)


def compose(first: list[tuple[int, int, int]], second: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The table of a block followed by another."""
    out: list[tuple[int, int, int]] = []
    for (least, closed, last), top in zip(first, [*[r[0] for r in first[1:]], math.inf]):
        if closed:
            more, fill = apply_table(second, last)
            out.append((least, closed + more, fill))
            continue
        # Nothing closed so far: the fill that comes to the second block is that of the start and the first block.
        for (at, more, end), above in zip(second, [*[r[0] for r in second[1:]], math.inf]):
            low = max(least, at - last)
            if low < min(top, above - last):
                out.append((low, more, end if more else last + end))
    return [r for i, r in enumerate(out) if not i or r[1:] != out[i - 1][1:] or not r[1]]


_TABLE = "block long, rows array<struct<least:int,closed:long,last:long>>"
_START = "block long, seq long, fill long"


def _rows(table: list) -> list[tuple[int, int, int]]:
    return [(r["least"], r["closed"], r["last"]) if not isinstance(r, tuple) else r for r in table]


def _starts(tables: DataFrame, group: int) -> DataFrame:
    """``block, seq, fill``: sequence and fill at which each block begins, from ``block, rows`` (one row a block)."""

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        whole = [_rows(r) for r in pdf["rows"]]
        table = whole[0]
        for t in whole[1:]:
            table = compose(table, t)
        return pd.DataFrame({"block": [int(pdf["up"].iat[0])], "rows": [[{"least": a, "closed": b, "last": c} for a, b, c in table]]})

    def spread_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        seq, fill = int(pdf["seq"].iat[0]), int(pdf["fill"].iat[0])
        out = []
        for block, rows in zip(pdf["block"], pdf["rows"]):
            out.append((block, seq, fill))
            closed, fill = apply_table(_rows(rows), fill)
            seq += closed
        return pd.DataFrame(out, columns=["block", "seq", "fill"])

    grouped = tables.withColumn("up", F.floor(F.col("block") / group).cast("long"))
    few = tables.limit(group + 1).count() <= group
    if few:
        top = grouped.withColumn("seq", F.lit(0).cast("long")).withColumn("fill", F.lit(0).cast("long")).withColumn("up", F.lit(0).cast("long"))
    else:
        above = _starts(checkpoint(grouped.groupBy("up").applyInPandas(merged, _TABLE)), group)
        top = grouped.join(above.select(F.col("block").alias("up"), "seq", "fill"), "up")
    return checkpoint(top.groupBy("up").applyInPandas(spread_out, _START))


def assign(docs: DataFrame, *, n_ctx: int = DEFAULT.n_ctx, order: tuple[str, ...] = ("source_id", "doc_id"), rows_a_block: int = 50_000, group: int = 256) -> DataFrame:
    """``doc_id, seq_id, offset, n_packed, truncated`` of each document with tokens.

    ``docs``: order columns, ``doc_id`` and ``n_packed0``, the length with its end mark before cutting. ``group``: tables that
    are composed in one task.
    """
    slim = docs.select(*dict.fromkeys([*order, "doc_id"]), F.least("n_packed0", F.lit(n_ctx)).cast("int").alias("n"), (F.col("n_packed0") > n_ctx).alias("truncated")).where("n > 0")
    blocks = ordered_blocks(slim, *order, rows_a_block=rows_a_block)
    keys = list(order)

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        t = block_table(pdf.sort_values(keys, na_position="first")["n"].tolist(), n_ctx)
        return pd.DataFrame({"block": [int(pdf["_block"].iat[0])], "rows": [[{"least": a, "closed": b, "last": c} for a, b, c in t]]})

    starts = _starts(checkpoint(blocks.groupBy("_block").applyInPandas(tables, _TABLE)), group)
    begun = blocks.join(starts.select(F.col("block").cast("int").alias("_block"), F.col("seq").alias("_seq"), F.col("fill").alias("_fill")), "_block")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, na_position="first")
        s, f = int(pdf["_seq"].iat[0]), int(pdf["_fill"].iat[0])
        seqs, offsets = [], []
        for n in pdf["n"].tolist():
            if f + n > n_ctx:
                s, f = s + 1, 0
            seqs.append(s)
            offsets.append(f)
            f += n
        return pd.DataFrame({"doc_id": pdf["doc_id"].tolist(), "seq_id": seqs, "offset": offsets, "n_packed": pdf["n"].tolist(), "truncated": pdf["truncated"].tolist()})

    kind = dict(slim.dtypes)["doc_id"]
    return begun.groupBy("_block").applyInPandas(place, f"doc_id {kind}, seq_id bigint, offset int, n_packed int, truncated boolean")


def sequences(docs: DataFrame, *, n_ctx: int = DEFAULT.n_ctx, order: tuple[str, ...] = ("source_id", "doc_id")) -> DataFrame:
    """``seq_id, token_ids``: packed sequences of exactly ``n_ctx`` ids. ``docs`` has ``token_ids``."""
    ended = docs.select(*dict.fromkeys([*order, "doc_id"]), with_eos(F.col("token_ids"), n_ctx).alias("ids"), _packed_length("token_ids").alias("n_packed0"))
    placed = assign(ended, n_ctx=n_ctx, order=order)
    joined = ended.select("doc_id", "ids").join(placed, "doc_id")
    # A sequence holds at most n_ctx documents.
    per = joined.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return per.select("seq_id", F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(n_ctx) - F.size(ids))).alias("token_ids"))


def _packed_length(ids: str) -> Column:
    n = F.size(ids)
    return F.when(n == 0, 0).otherwise(n + F.when(F.element_at(ids, -1) == EOS, 0).otherwise(1))


def shard_of(seq_id: Column, n_ctx: int = DEFAULT.n_ctx, target: int = DEFAULT.shard_target_tokens) -> Column:
    """Shards close at the first sequence that reaches the target, so each holds the same number of sequences."""
    return F.floor(seq_id / math.ceil(target / n_ctx)).cast("int")


def stats(placed: DataFrame, *, n_ctx: int = DEFAULT.n_ctx, target: int = DEFAULT.shard_target_tokens) -> DataFrame:
    """One row: sequences, shards, packed and pad tokens, waste and truncated documents."""
    a = placed.agg(F.coalesce(F.max("seq_id") + 1, F.lit(0)).alias("n_sequences"), F.coalesce(F.sum("n_packed"), F.lit(0)).alias("used"), F.count_if("truncated").alias("truncated_docs"))
    per = math.ceil(target / n_ctx)
    packed = F.col("n_sequences") * n_ctx
    return a.select(
        "n_sequences", F.ceil(F.col("n_sequences") / per).alias("n_shards"), packed.alias("packed_tokens"), (packed - F.col("used")).alias("pad_tokens"),
        F.when(packed > 0, (packed - F.col("used")) / packed).otherwise(F.lit(0.0)).alias("waste_ratio"), "truncated_docs", F.lit(n_ctx).alias("n_ctx"),
    )


def shards(placed: DataFrame, *, n_ctx: int = DEFAULT.n_ctx, target: int = DEFAULT.shard_target_tokens) -> DataFrame:
    """``shard_id, n_sequences``."""
    return placed.select("seq_id").distinct().groupBy(shard_of(F.col("seq_id"), n_ctx, target).alias("shard_id")).agg(F.count("*").alias("n_sequences"))


def holdout(seq: DataFrame, frac: float = 0.02, tail: bool = False) -> DataFrame:
    """Add ``split``: the first ``max(1, int(n * frac))`` sequences are eval. ``tail``: the last tenth instead."""
    n = seq.agg(F.coalesce(F.max("seq_id") + 1, F.lit(0)).alias("_n"))
    first = F.greatest(F.lit(1), F.floor(F.col("_n") * frac))
    rule = F.col("seq_id") >= F.floor(F.col("_n") * 0.9) if tail else F.col("seq_id") < first
    return seq.crossJoin(F.broadcast(n)).withColumn("split", F.when(rule, "eval").otherwise("train")).drop("_n")


def validate(seq: DataFrame, vocab_size: int = 32_768) -> DataFrame:
    """One row: least and largest id, ids out of range, tokens that are no padding."""
    ids = F.col("token_ids")
    return seq.agg(
        F.min(F.array_min(ids)).alias("min_id"), F.max(F.array_max(ids)).alias("max_id"),
        F.coalesce(F.sum(F.size(F.filter(ids, lambda x: (x < 0) | (x >= vocab_size)))), F.lit(0)).alias("n_out_of_range"),
        F.coalesce(F.sum(F.size(F.filter(ids, lambda x: x != PAD))), F.lit(0)).alias("non_pad_tokens"),
    )


def weighted_loss(batches: DataFrame, loss: str = "loss", tokens: str = "non_pad_tokens") -> DataFrame:
    """Mean loss weighted by the tokens that are no padding; null without any."""
    return batches.agg((F.sum(F.col(loss) * F.col(tokens)) / F.nullif(F.sum(tokens), F.lit(0))).alias("mean_loss"), F.sum(tokens).alias("n_tokens"))


def make_batch(seq: DataFrame, batch_size: int, vocab_size: int = 32_768) -> list[list[int]]:
    """The first ``batch_size`` sequences, repeated from the start if there are fewer; ids must be in range."""
    rows = [list(r["token_ids"]) for r in seq.orderBy("seq_id").limit(batch_size).collect()]
    if not rows:
        raise ValueError("there is no sequence")
    if any(not 0 <= i < vocab_size for ids in rows for i in ids):
        raise ValueError("a token id is out of range")
    return [rows[k % len(rows)] for k in range(batch_size)]
