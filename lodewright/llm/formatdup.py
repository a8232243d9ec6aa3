"""Problem 5: records that differ only in format.

A text's canonical form is its letters and digits in compatibility form (full-width letters, ligatures and
composed accents are those they stand for), case folded. A *record* (one JSON object, or at
least four lines, all ``name: value``) has a second canonical form, its fields in sorted order. Both
forms are hashed to 128 bits; a second, independent 64-bit hash, seeded with the length, goes with
each key, so texts whose 128 bits collide stay apart; ``collisions`` counts them. Copies are counted by an
aggregation with map-side combining; only texts of which a record is a copy go on to the join over field order.

Defined results: texts that are null or hold no letter or digit are copies of nothing, each is a
record of its own in ``collapse``. The lowest id represents a text; repeated rows count as copies.
Rows with a null id do not represent and are not listed by ``copies``, but are counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.llm.common import NOT_ALNUM, reliable, spread

_LINE = re.compile(r"\s*[^\s:][^:\n]*:.*")


def letters(text: str) -> str:
    if not text.isascii():
        text = normalize("NFKC", normalize("NFKC", text).casefold())
    return NOT_ALNUM.sub("", text.lower())


def _check(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, len(raw)) - (1 << 63)


def _flat(value: object) -> str:
    return letters(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def fields(text: str) -> list[tuple[str, str]] | None:
    """Sorted canonical fields of a record, None for other texts. Names may repeat."""
    s = text.strip()
    if s[:1] == "{" and s[-1:] == "}":
        try:
            pairs = json.loads(s, object_pairs_hook=_Pairs)
        except (ValueError, RecursionError):
            return None
        return sorted((letters(k), _flat(v)) for k, v in pairs.items) if pairs.items else None
    lines = [x for x in s.split("\n") if x.strip()]
    if len(lines) < 4 or not all(map(_LINE.fullmatch, lines)):
        return None
    return sorted((letters(k), letters(v)) for k, _, v in (x.partition(":") for x in lines))


class _Pairs:
    """A JSON object as its pairs; nested ones print as plain objects."""

    def __init__(self, items: list) -> None:
        self.items = [(k, _plain(v)) for k, v in items]


def _plain(v: object) -> object:
    if isinstance(v, _Pairs):
        return dict(v.items)
    return [_plain(x) for x in v] if isinstance(v, list) else v


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, check, two = [], [], []
        for text in batch.column(1).to_pylist():
            canon = letters(text) if text else ""
            if not canon:
                one.append(None), check.append(None), two.append(None)
                continue
            raw = canon.encode()
            one.append(xxhash.xxh3_128_digest(raw))
            check.append(_check(raw))
            f = fields(text)
            raw = b"" if f is None else "\x1f".join(f"{len(a)}:{a}={b}" for a, b in f).encode()
            # The check hash of the fields is part of their key.
            two.append(None if f is None else xxhash.xxh3_128_digest(raw) + (_check(raw) + (1 << 63)).to_bytes(8, "little"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.binary()), pa.array(check, pa.int64()), pa.array(two, pa.binary())], names=["doc_id", "k", "check", "f"])


def canonical_keys(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, k, check, f``: letter key with its check hash, field key of records."""
    src = spread(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return src.mapInArrow(_keys, "doc_id bigint, k binary, check bigint, f binary")


def collapse(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(texts, members)``.

    texts: ``first_doc_id, copies``, one row per distinct text. members: ``first_doc_id, doc_id``,
    one row per document that carries a text.
    """
    keyed = reliable(canonical_keys(documents, id_col=id_col, text_col=text_col))
    has = keyed.where("k is not null")
    # Map-side combined: one row per text, however hot it is.
    groups = has.groupBy("k", "check").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    # Texts with records join over the field key. A text's letters nearly always fix its fields;
    # where not (the same letters cut into other fields) all its field keys count.
    links = has.where("f is not null").groupBy("k", "check", "f").agg(F.min("doc_id").alias("low"))
    groups = reliable(groups)
    roots = _roots(links, groups)
    first = groups.join(roots, ["k", "check"], "left").select("k", "check", "n", "low", F.coalesce("root", "low").alias("first_doc_id"))
    members = has.join(first.select("k", "check", "first_doc_id"), ["k", "check"]).select("first_doc_id", "doc_id")
    texts = first.groupBy("first_doc_id").agg(F.sum("n").alias("copies"))
    blank = keyed.where("k is null").select(F.col("doc_id").alias("first_doc_id"), F.lit(1).cast("bigint").alias("copies"))
    return texts.unionByName(blank), members


def _roots(links: DataFrame, groups: DataFrame) -> DataFrame:
    """``k, check, root``: lowest id over texts joined through shared field keys, for texts with records.

    Two rounds of minima (over field key, then letter key) settle all but chains of texts whose
    letters are cut into different fields; rounds go on until nothing changes.
    """
    state = links.join(groups.select("k", "check", F.col("low").alias("root")), ["k", "check"]).select("k", "check", "f", "root")
    state = reliable(state)
    while True:
        by_f = state.groupBy("f").agg(F.min("root").alias("over_f"))
        new = state.join(by_f, "f")
        by_k = new.groupBy("k", "check").agg(F.min("over_f").alias("over_k"))
        new = reliable(new.join(by_k, ["k", "check"]).select("k", "check", "f", F.col("over_k").alias("root"), (F.col("over_k") != F.col("over_f")).alias("moved")))
        state = new.drop("moved")
        if not new.where("moved").take(1):
            return state.groupBy("k", "check").agg(F.min("root").alias("root"))


def collisions(keyed: DataFrame) -> DataFrame:
    """One row: ``n_texts, n_text_collisions, n_fields, n_field_collisions``; a collision is one 128-bit hash with several check hashes."""
    texts = keyed.where("k is not null").groupBy("k", "check").agg(F.lit(1).alias("one")).groupBy("k").agg(F.count("*").alias("m"))
    a = texts.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_texts"), F.count_if(F.col("m") > 1).alias("n_text_collisions"))
    parts = keyed.where("f is not null").select(F.substring("f", 1, 16).alias("h"), F.substring("f", 17, 8).alias("c")).distinct().groupBy("h").agg(F.count("*").alias("m"))
    b = parts.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_fields"), F.count_if(F.col("m") > 1).alias("n_field_collisions"))
    return a.crossJoin(b)  # one row each


def copies(documents: DataFrame, **cols: str) -> DataFrame:
    """``first_doc_id, doc_id``: each document that is a copy of an earlier id."""
    _, members = collapse(documents, **cols)
    return members.where("doc_id <> first_doc_id")
