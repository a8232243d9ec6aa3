"""The byte-level vocabulary: special tokens, greedy longest-match encoding, decoding, files."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.operators.base import spread

# The id layout.
SPECIALS = {"<pad>": 0, "<unk>": 1, "<bos>": 2, "<eos>": 3}
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
FIRST_BYTE_ID = 4
FIRST_MERGE_ID = 260


@dataclass
class Vocabulary:
    """Token bytes by id, and the merges that made them.

    Merges are kept for identity and study; encoding is a greedy longest match on bytes.
    """

    algorithm: str
    token_bytes: list[bytes]
    merges: list[list[int]] = field(default_factory=list)
    char_to_id: dict[str, int] = field(default_factory=dict)
    version: str = "1.0.0"
    normalization: str = "identity"
    metadata: dict = field(default_factory=dict)
    _automaton: object = field(default=None, repr=False, compare=False)

    @property
    def size(self) -> int:
        return len(self.token_bytes)

    @property
    def fingerprint(self) -> str:
        """Identity of the vocabulary: sha256 of its compact sorted JSON."""
        identity = {
            "version": self.version, "algorithm": self.algorithm, "vocab_size": self.size, "normalization": self.normalization, "merges": self.merges,
            "token_bytes": [base64.b64encode(b).decode() for b in self.token_bytes], "char_to_id": self.char_to_id,
        }
        return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def _usable(self) -> dict[str, int]:
        """Latin-1 image of each usable token; of equal tokens the highest id counts."""
        return {b.decode("latin-1"): i for i, b in enumerate(self.token_bytes) if i >= FIRST_BYTE_ID and b and not b.startswith(b"<unused_")}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def encode(self, text: str, *, bos: bool = False, eos: bool = False) -> list[int]:
        if not isinstance(text, str):
            raise TypeError("text must be a string")
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for t, i in self._usable().items():
                self._automaton.add_word(t, i)
            self._automaton.make_automaton()
        # Every byte is a token, so leftmost-longest matches tile the text: that is the greedy encoding.
        ids = [i for _, i in self._automaton.iter_long(text.encode().decode("latin-1"))] if text else []
        return [BOS_ID] * bos + ids + [EOS_ID] * eos

    def decode(self, ids: list[int], *, skip_special_tokens: bool = True) -> str:
        names = {i: n for n, i in SPECIALS.items()}
        out = b""
        for i in ids:
            if not 0 <= i < self.size:
                raise ValueError(f"token id {i} is out of range")
            if i in names:
                out += b"" if skip_special_tokens else names[i].encode()
            else:
                out += self.token_bytes[i]
        return out.decode("utf-8")

    def to_json(self) -> dict:
        return {
            "version": self.version, "algorithm": self.algorithm, "vocab_size": self.size, "normalization": self.normalization, "merges": self.merges, "char_to_id": self.char_to_id,
            "token_bytes_b64": [base64.b64encode(b).decode() for b in self.token_bytes], "metadata": self.metadata, "fingerprint": self.fingerprint,
        }

    @classmethod
    def from_json(cls, data: dict) -> Vocabulary:
        v = cls(data["algorithm"], [base64.b64decode(x) for x in data["token_bytes_b64"]], [list(m) for m in data["merges"]], dict(data["char_to_id"]), data["version"], data["normalization"], dict(data.get("metadata", {})))
        if data.get("fingerprint") not in (None, v.fingerprint):
            raise ValueError("the vocabulary file does not match its fingerprint")
        return v

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_json(), sort_keys=True) + "\n", encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path, fingerprint: str | None = None) -> Vocabulary:
        """Load a vocabulary; with ``fingerprint`` it must be that one."""
        v = cls.from_json(json.loads(Path(path).read_text(encoding="utf-8")))
        if fingerprint is not None and v.fingerprint != fingerprint:
            raise ValueError("the vocabulary is not the one asked for")
        return v

    def table(self, spark) -> DataFrame:
        """``id, token, kind`` of every id."""
        kind = lambda i, b: "special" if i < FIRST_BYTE_ID else "byte" if i < FIRST_MERGE_ID else "unused" if b.startswith(b"<unused_") else "piece"
        return spark.createDataFrame([(i, bytearray(b), kind(i, b)) for i, b in enumerate(self.token_bytes)], "id int, token binary, kind string")


def empty_tokens(size: int) -> list[bytes]:
    out = [b""] * size
    for name, i in SPECIALS.items():
        out[i] = name.encode()
    for b in range(256):
        out[FIRST_BYTE_ID + b] = bytes([b])
    return out


def _encode(vocabulary: Vocabulary, eos: bool, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [vocabulary.encode(t or "", eos=eos) for t in batch.column(1).to_pylist()]
            sizes = [len(x) for x in ids]
            if counts:
                got = pa.array(sizes, pa.int32())
            else:
                flat = np.fromiter((i for x in ids for i in x), np.int32, sum(sizes))
                got = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), got], names=[batch.schema.names[0], "token_count" if counts else "token_ids"])

    return run


def encode_column(df: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", eos: bool = True) -> DataFrame:
    """``id_col, token_ids``: canonical ids (with an end mark)."""
    src = spread(df.select(id_col, text_col))
    return src.mapInArrow(_encode(vocabulary, eos, False), f"{id_col} {src.schema[0].dataType.simpleString()}, token_ids array<int>")


def count_column(df: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", eos: bool = False) -> DataFrame:
    """``id_col, token_count``: measured sizes (without an end mark)."""
    src = spread(df.select(id_col, text_col))
    return src.mapInArrow(_encode(vocabulary, eos, True), f"{id_col} {src.schema[0].dataType.simpleString()}, token_count int")


def token_count(text: Column, vocabulary: Vocabulary) -> Column:
    """Number of ids of a text (without an end mark) as a column, so that it shares a pass with other Arrow UDFs."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(vocabulary.encode(t or "")))

    return run(text)
