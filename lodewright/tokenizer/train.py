"""Training of the byte-level vocabulary: distributed line counts, merges over the distinct lines.

The corpus collapses to distinct lines with counts in Spark (map-side combining); the distinct lines of the
fixed training corpus are about a thousand, so the merge loop runs on the driver, with pair counts kept up
to date incrementally. ``pair_counts`` is the distributed form of one counting round.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.tokenizer.model import FIRST_BYTE_ID, FIRST_MERGE_ID, Vocabulary, empty_tokens

# Pieces the code-aware vocabulary always holds, in this order (repeats keep a slot).
CODE_KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
)
CODE_OPERATORS = ("==", "!=", "<=", ">=", "//", "**", "->", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "//=", "**=", "<<", ">>", "...")
CODE_EXTRAS = (
    "    ", "\t", "\n", "\n    ", "import ", "from ", "def ", "class ", "return ", "self.", "None", "True", "False", "__init__", "__name__", "print(", "range(", "len(", "typing", "Optional", "List", "Dict",
)


def code_pieces() -> list[bytes]:
    return [p.encode() for p in (*CODE_KEYWORDS, *CODE_OPERATORS, *CODE_EXTRAS)]


def seeded_bytes(data: bytes, pieces: list[bytes]) -> list[int]:
    """Byte ids of a text read piece by piece. A piece enters training as its bytes, so the ids are those of the bytes, whatever the pieces."""
    known = sorted({p for p in pieces if p}, key=len, reverse=True)
    ids, at = [], 0
    while at < len(data):
        piece = next((p for p in known if data.startswith(p, at)), data[at : at + 1])
        ids += [FIRST_BYTE_ID + b for b in piece]
        at += len(piece)
    return ids


def line_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    r"""``line, n``: lines with their line ends. A line ends after \n, \r\n, \r and the other marks of ``splitlines``."""
    ends = r"(?<=\r\n)|(?<=[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])|(?<=\r)(?!\n)"
    return texts.select(F.explode(F.split(text_col, ends)).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


def pair_counts(lines: DataFrame) -> DataFrame:
    """``left, right, n``: adjacent byte pairs over distinct lines, weighted by the lines' counts (one counting round)."""
    b = lines.select(F.encode("line", "UTF-8").alias("b"), "n")
    at = F.explode(F.sequence(F.lit(1), F.octet_length("b") - 1)).alias("i")
    pairs = b.where(F.octet_length("b") > 1).select("b", "n", at)
    byte = lambda off: F.conv(F.hex(F.substring("b", F.col("i") + off, F.lit(1))), 16, 10).cast("int") + FIRST_BYTE_ID
    return pairs.select(byte(0).alias("left"), byte(1).alias("right"), "n").groupBy("left", "right").agg(F.sum("n").alias("n"))


def best_pair(counts: DataFrame) -> DataFrame:
    """Most frequent pair; ties go to the smaller left, then right id."""
    return counts.orderBy(F.desc("n"), "left", "right").limit(1)


def apply_merge(ids: list[int], left: int, right: int, new: int) -> list[int]:
    """Replace the pair from left to right, without overlap."""
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and ids[i] == left and ids[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def merge_by_rank(ids: list[int], merges: list[list[int]]) -> list[int]:
    """BPE by merge priority (not used by encoding, which is greedy)."""
    rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
    while len(ids) > 1:
        r = min((rank[p] + p for p in zip(ids, ids[1:]) if p in rank), default=None)
        if r is None:
            break
        ids = apply_merge(ids, r[2], r[3], r[1])
    return ids


def learn_merges(lines: Counter, n_merges: int, first_id: int) -> list[list[int]]:
    """Merges ``[left, right, new]`` until ``n_merges`` or until no pair occurs twice."""
    seqs = [[list(k), n] for k, n in lines.items()]
    counts: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for s, (ids, n) in enumerate(seqs):
        for p in zip(ids, ids[1:]):
            counts[p] += n
            where[p].add(s)
    merges: list[list[int]] = []
    while len(merges) < n_merges and counts:
        (left, right), n = min(counts.items(), key=lambda kv: (-kv[1], kv[0]))
        if n < 2:
            break
        new = first_id + len(merges)
        merges.append([left, right, new])
        for s in where.pop((left, right)):
            ids, m = seqs[s]
            for p in zip(ids, ids[1:]):
                counts[p] -= m
                if not counts[p]:
                    del counts[p]
            ids = apply_merge(ids, left, right, new)
            seqs[s][0] = ids
            for p in zip(ids, ids[1:]):
                counts[p] += m
                where[p].add(s)
    return merges


def _units(algorithm: str, texts: list[str]) -> dict[str, int]:
    """Characters in order of first appearance, for the character-based variant."""
    return dict.fromkeys(c for t in texts for c in t) if algorithm == "unicode_bpe_bytes" else {}


def train(texts: list[str], algorithm: str = "byte_bpe_code", size: int = 32_768, name: str | None = None, lines: Counter | None = None) -> Vocabulary:
    """Train ``byte_bpe``, ``byte_bpe_code`` or ``unicode_bpe_bytes``.

    ``lines``: counts of lines, e.g. collected from ``line_counts``; by default those of ``texts``.
    """
    if algorithm not in ("byte_bpe", "byte_bpe_code", "unicode_bpe_bytes"):
        raise ValueError(f"unknown algorithm: {algorithm}")
    tokens = empty_tokens(size)
    counts = lines if lines is not None else Counter(x for t in texts for x in t.splitlines(keepends=True))
    at, chars = FIRST_MERGE_ID, {}
    if algorithm == "unicode_bpe_bytes":
        chars = {c: FIRST_MERGE_ID + k for k, c in enumerate(_units(algorithm, texts)) if FIRST_MERGE_ID + k < size}
        for c, i in chars.items():
            tokens[i] = c.encode()
        at += len(chars)
        seqs = Counter({tuple(chars[c] for c in x): n for x, n in counts.items()})
    else:
        if algorithm == "byte_bpe_code":
            for p in code_pieces():
                tokens[at] = p
                at += 1
        seqs = Counter({tuple(FIRST_BYTE_ID + b for b in x.encode()): n for x, n in counts.items()})
    merges = learn_merges(seqs, max(0, size - at), at)
    for left, right, new in merges:
        tokens[new] = tokens[left] + tokens[right]
    used = at + len(merges)
    for i in range(used, size):
        tokens[i] = f"<unused_{i}>".encode()
    return Vocabulary(algorithm, tokens, merges, chars, metadata={"candidate": name or algorithm, "n_merges": len(merges), "n_unused": size - used})
