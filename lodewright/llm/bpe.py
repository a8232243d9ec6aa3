"""Problem 7: byte-level BPE encoding of a whole corpus by longest matches with backtracking.

A text is cut into pieces by the tokenizer's pattern. A piece's UTF-8 bytes are mapped to Latin-1
so that an Aho-Corasick automaton over the vocabulary can find longest matches. The greedy sequence
of longest matches is the BPE result if each pair of neighbours is *compatible*, that is, if BPE of
both tokens' bytes gives these two tokens back; otherwise the last token is shortened or dropped
until all neighbours are. Compatibility is memoised, a position that failed is never tried again,
so the work is linear in the piece and the ids are exactly those of the merge procedure.

Defined results: null and empty texts give an empty list; any other text gives the ids without
special tokens (the strings of special tokens are ordinary text). Repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodewright.llm.common import ship_file, shipped_file, spread, tokenizer_file

# White space as the tokenizer's own pattern engine reads \s (fixed by Unicode).
_WS = r"\t-\r \x85\xa0  -     　"
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = re.compile(rf"{_CONTRACTIONS}| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_UNICODE = regex.compile(rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
MAX_CACHED_PIECES = 200_000


def _byte_chars() -> dict[str, int]:
    """Inverse of the byte-to-printable-character table of byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        table[chr(256 + n)] = b
    return table


class BytePairEncoder:
    """Exact BPE of a byte-level vocabulary file (the JSON form of the ``tokenizers`` library)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _byte_chars()

        def latin(token: str) -> str:
            return "".join(chr(to_byte[c]) for c in token)

        self.bytes_of: dict[int, str] = {}
        self.id_of: dict[str, int] = {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        wanted = {c for c in to_byte} | {a + b for a, b in merges}
        for token, i in model["vocab"].items():
            if token in wanted:
                self.bytes_of[i] = t = latin(token)
                self.id_of[t] = i
        top = max(self.bytes_of) + 1
        self.shift = top.bit_length()
        self.length = [len(self.bytes_of.get(i, "")) for i in range(top)]
        # Rank of the merge that makes a token, and its two parts; -1 for single bytes.
        self.order, self.left, self.right = [-1] * top, [-1] * top, [-1] * top
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = (model["vocab"][x] for x in (a, b, a + b))
            self.rank[left << self.shift | right] = r
            if self.order[whole] < 0:
                self.order[whole], self.left[whole], self.right[whole] = r, left, right
        self.shorter = [-1] * top  # the longest token that is a proper prefix
        for i, t in self.bytes_of.items():
            for n in range(len(t) - 1, 0, -1):
                if (p := self.id_of.get(t[:n], -1)) >= 0:
                    self.shorter[i] = p
                    break
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, array] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes keeps the cut between them (memoised).

        Undo the later of the two tokens' last merges step by step along the cut: the cut is kept
        if no pair that meets at it would have been merged earlier than the merge that hid it. At
        equal rank the leftmost occurrence is merged first.
        """
        key = a << self.shift | b
        rank, order, left, right, shift = self.rank, self.order, self.left, self.right, self.shift
        before = 1 << 60
        got = True
        while True:
            r = rank.get(a << shift | b)
            if r is not None and 2 * r < before:
                got = False
                break
            x, y = order[a], order[b]
            if x > y:
                before, a = 2 * x, right[a]
            elif y >= 0:
                before, b = 2 * y + 1, left[b]
            else:
                break
        self._fits[key] = got
        return got

    def _piece(self, piece: str) -> array:
        s = piece.encode("utf-8").decode("latin-1")
        whole = self.id_of.get(s)
        return array("i", (whole,)) if whole is not None else array("i", self._backtrack(s))

    def _backtrack(self, s: str) -> list[int]:
        length, shorter, fits, shift = self.length, self.shorter, self._fits, self.shift
        iter_long, end = self.automaton.iter_long, len(s)
        greedy = iter_long(s)  # stays in step with the result as long as no token is shortened
        out: list[int] = []
        dead = bytearray(end + 1)
        at, last, on_greedy = 0, -1, True
        token = next(greedy)[1]
        while True:
            longest = token
            while token >= 0:
                if not dead[at + length[token]]:
                    if last < 0:
                        break
                    f = fits.get(last << shift | token)
                    if f is None:
                        f = self.compatible(last, token)
                    if f:
                        break
                token = shorter[token]
            if token >= 0:
                on_greedy = on_greedy and token == longest
                out.append(token)
                at += length[token]
                if at == end:
                    return out
                last = token
                token = next(greedy if on_greedy else iter_long(s, at, end))[1]
            else:
                on_greedy = False
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def encode_into(self, text: str, out: array) -> None:
        cache = self._pieces
        for piece in (_ASCII if text.isascii() else _UNICODE).findall(text):
            try:
                out.extend(cache[piece])
            except KeyError:
                ids = self._piece(piece)
                if len(piece) <= 64:
                    if len(cache) >= MAX_CACHED_PIECES:
                        cache.clear()
                    cache[piece] = ids
                out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()


_LOADED: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = BytePairEncoder(path)
    return _LOADED[path]


def _encode_batches(name: str, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped_file(name))
        for batch in batches:
            flat, ends = array("i"), [0]
            texts = batch.column(1).to_pylist()
            for text in texts:
                if text:
                    enc.encode_into(text, flat)
                    if lengths_only:
                        ends.append(ends[-1] + len(flat))
                        del flat[:]
                        continue
                ends.append(len(flat) if not lengths_only else ends[-1])
            offsets = np.asarray(ends, dtype=np.int64)
            if lengths_only:
                got = pa.array(np.diff(offsets))
            else:
                got = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), got], names=[batch.schema.names[0], "n_tokens" if lengths_only else "ids"])

    return run


def token_ids(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col, ids``: the token ids of each row's text; empty list for empty and null texts.

    ``vocabulary`` is the path of a byte-level BPE vocabulary (JSON). Other columns are not read.
    """
    path = vocabulary or tokenizer_file("byte_bpe_50k.json")
    src = spread(documents.select(id_col, text_col))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(_encode_batches(ship_file(documents.sparkSession, path), False), f"`{id_col}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col, n_tokens``: sizes of the texts in tokens, without handing the ids back to the JVM."""
    path = vocabulary or tokenizer_file("byte_bpe_50k.json")
    src = spread(documents.select(id_col, text_col))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(_encode_batches(ship_file(documents.sparkSession, path), True), f"`{id_col}` {kind}, n_tokens bigint")
