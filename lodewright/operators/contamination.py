"""Decontamination: documents that share a token n-gram or a character window with a reference text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.config import DEFAULT, Thresholds
from lodewright.functions.text import words
from lodewright.operators.base import checkpoint, spread

MAX_BROADCAST_GRAMS = 2_000_000  # of about 40 bytes each
FILTER_SEGMENTS, SEGMENT_BYTES = 256, 1 << 18  # Bloom filter of a larger index: 64 MB, whatever the index holds


def token_ngrams(text: str, n: int) -> list[str]:
    w = text.split()
    if len(w) < n:
        return [" ".join(w)] if w else []
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def char_windows(text: str, n: int) -> list[str]:
    if len(text) < n:
        return [text] if text else []
    return [text[i : i + n] for i in range(len(text) - n + 1)]


class GramFilter:
    """A Bloom filter in segments: the lowest byte of a gram's hash names the segment, three runs of 21 bits its bits."""

    def __init__(self, segments: dict[int, bytes]) -> None:
        self.segments = segments

    @staticmethod
    def probes(gram: int) -> tuple[int, int, int]:
        return gram >> 8 & 0x1FFFFF, gram >> 22 & 0x1FFFFF, gram >> 43 & 0x1FFFFF

    @staticmethod
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """One segment from its grams."""
        bits = np.zeros(SEGMENT_BYTES * 8, np.uint8)
        g = pdf["gram"].to_numpy(np.int64).view(np.uint64)
        for shift in (8, 22, 43):
            bits[(g >> np.uint64(shift) & np.uint64(0x1FFFFF)).astype(np.int64)] = 1
        return pd.DataFrame({"segment": [int(pdf["segment"].iat[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    @classmethod
    def of(cls, index: DataFrame) -> GramFilter:
        """Built on the executors; what comes to the driver is bounded by the filter's size."""
        rows = index.select(F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("segment"), "gram").groupBy("segment").applyInPandas(cls.build, "segment int, bits binary")
        return cls({r["segment"]: bytes(r["bits"]) for r in rows.collect()})

    def __rand__(self, grams: set[int]) -> set[int]:
        """Those of the grams the index may hold."""
        out = set()
        for g in grams:
            bits = self.segments.get(g & 255)
            if bits is not None and all(bits[p >> 3] >> (p & 7) & 1 for p in self.probes(g)):
                out.add(g)
        return out


def _grams(n_tokens: int, n_chars: int, known: frozenset[int] | GramFilter | None = None, sent: Broadcast | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        held = known if sent is None else sent.value
        for batch in batches:
            row, kind, gram = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                for k, grams in ((0, token_ngrams(text, n_tokens)), (1, char_windows(text, n_chars))):
                    found = {h(g.encode("utf-8", "surrogatepass"), seed=k) for g in grams}
                    if held is not None:
                        found = found & held
                    row += [i] * len(found)
                    kind += [k] * len(found)
                    gram += found
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(kind, pa.int32()), pa.array([g - (1 << 64) if g >= 1 << 63 else g for g in gram], pa.int64())], names=[batch.schema.names[0], "kind", "gram"])

    return run


def reference_index(refs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """``kind, gram, ref_ord, ref_id`` of ``refs`` (``ref_id, ref_ord, text``); the first reference owns a gram."""
    src = refs.select(F.struct("ref_ord", "ref_id").alias("ref"), "text")
    grams = src.mapInArrow(_grams(t.token_ngram, t.char_window), "ref struct<ref_ord:bigint,ref_id:string>, kind int, gram bigint")
    return grams.groupBy("kind", "gram").agg(F.min("ref").alias("ref")).select("kind", "gram", "ref.ref_ord", "ref.ref_id")


def hits(docs: DataFrame, refs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """``doc_id, source_id, matched_ref, action, unresolved`` of every document that holds a reference gram.

    Of several references the token match comes before the window match, then the first reference. Before any
    gram leaves the worker it is held against the index, or against a Bloom filter of a larger one; what is
    left is joined with the index, so hardly more than true hits are shuffled.
    """
    index = checkpoint(reference_index(refs.select(F.col("ref_id").cast("string").alias("ref_id"), F.col("ref_ord").cast("bigint").alias("ref_ord"), "text"), t))
    n = index.count()
    src = spread(docs.select(F.struct("doc_id", "source_id").alias("doc"), "text"))
    few = n <= MAX_BROADCAST_GRAMS
    held = frozenset(r[0] % (1 << 64) for r in index.select("gram").collect()) if few else GramFilter.of(index)
    kind = src.schema["doc"].dataType.simpleString()
    grams = src.mapInArrow(_grams(t.token_ngram, t.char_window, sent=docs.sparkSession.sparkContext.broadcast(held)), f"doc {kind}, kind int, gram bigint")
    joined = grams.join(F.broadcast(index) if few else index, ["kind", "gram"])
    best = joined.groupBy("doc").agg(F.min_by("ref_id", F.struct("kind", "ref_ord")).alias("matched_ref"))
    return best.select("doc.doc_id", "doc.source_id", "matched_ref", F.lit("removed").alias("action"), F.lit(False).alias("unresolved"))


def scan(docs: DataFrame, refs: DataFrame, t: Thresholds = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``(kept, hits)``; kept rows are marked ``clear``."""
    found = hits(docs, refs, t)
    kept = docs.join(found.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    if "contamination_risk" in docs.columns:
        kept = kept.withColumn("contamination_risk", F.lit("clear"))
    return kept, found


def report(found: DataFrame, refs: DataFrame, missing: list[str] | None = None) -> DataFrame:
    """One row: ``n_refs, n_hits, n_unresolved, benchmark_refs_missing``."""
    n = refs.agg(F.count("*").alias("n_refs"))
    h = found.agg(F.count("*").alias("n_hits"))
    return n.crossJoin(h).select("n_refs", "n_hits", F.lit(0).alias("n_unresolved"), F.array(*[F.lit(m) for m in missing or []]).cast("array<string>").alias("benchmark_refs_missing"))


def ngram_counts(docs: DataFrame, n: int) -> DataFrame:
    """Distinct token n-grams per document, in the JVM. The inner explode keeps the split from being repeated per gram."""
    tokens = docs.select("doc_id", F.explode(F.array(words(F.col("text")))).alias("w"))
    size = F.size("w")
    grams = F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join("w", " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    )
    return tokens.select("doc_id", F.size(F.array_distinct(grams)).alias("n_grams"))
