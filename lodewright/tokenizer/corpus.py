"""The fixed evaluation texts and the synthetic training texts of the vocabulary."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

CORPUS_VERSION = "stage3-eval-v1"

# Names and texts of the evaluation corpus. The vocabulary's fingerprint depends on them.
EVALUATION: dict[str, str] = {
    "python/imports": "import os\nimport sys\nfrom typing import Optional, List, Dict, Tuple\nfrom pathlib import Path\nimport numpy as np\n",
    "python/function": "def add(x: int, y: int) -> int:\n    return x + y\n",
    "python/class": "class Point:\n    def __init__(self, x: float, y: float) -> None:\n        self.x = x\n        self.y = y\n\n    def dist(self) -> float:\n        return (self.x ** 2 + self.y ** 2) ** 0.5\n",
    "python/decorator": "from functools import wraps\n\ndef logged(fn):\n    @wraps(fn)\n    def inner(*args, **kwargs):\n        return fn(*args, **kwargs)\n    return inner\n\n@logged\ndef run() -> None:\n    pass\n",
    "python/comprehension": "squares = [i * i for i in range(10) if i % 2 == 0]\nmapping = {k: v for k, v in enumerate(squares)}\nunique = {x for x in squares}\n",
    "python/generator": "def countdown(n: int):\n    while n > 0:\n        yield n\n        n -= 1\n",
    "python/async": "async def fetch(url: str) -> str:\n    await ready()\n    return url\n\nasync def ready() -> None:\n    return None\n",
    "python/exceptions": "try:\n    raise ValueError('bad')\nexcept ValueError as exc:\n    print(exc)\nfinally:\n    pass\n",
    "python/context": "from contextlib import contextmanager\n\n@contextmanager\ndef opened(path):\n    f = open(path, 'r', encoding='utf-8')\n    try:\n        yield f\n    finally:\n        f.close()\n",
    "python/fstring": 'name = "Ada"\nvalue = 3.14159\nmsg = f"{name}: {value:.2f}"\n',
    "python/strings": "a = 'single'\nb = \"double\"\nc = '''triple'''\nd = \"\"\"also\"\"\"\n",
    "python/comments": "# leading comment\nx = 1  # inline comment\n",
    "python/indent": "def nest(flag: bool) -> int:\n    if flag:\n        if True:\n            return 1\n        return 2\n    return 0\n",
    "python/operators": "x = 1 + 2 - 3 * 4 / 5 // 6 % 7 ** 2\nok = a == b and c != d or e <= f and g >= h\nbits = (m << 2) | (n >> 1) & ~mask\nx += 1\nx := 2\n",
    "python/walrus_ann": "def parse(items: list[int]) -> int | None:\n    if (n := len(items)) > 0:\n        return n\n    return None\n",
    "python/unicode_ident": "π = 3.14159\nΔt = 1e-3\ndef café(α: float) -> float:\n    return α * π\n",
    "python/long_ident": "def compute_normalized_mean_squared_error_estimate(prediction_vector, target_vector):\n    return ((prediction_vector - target_vector) ** 2).mean()\n",
    "python/punctuation": "data = {'a': [1, 2, 3], 'b': (4, 5), 'c': {6, 7}}\ncall(foo, bar=baz, *args, **kwargs)\n",
    "python/nested": "result = [[f(x) for x in row if x] for row in matrix if row]\n",
    "python/tabs_spaces": "def mixed():\n\treturn 1\n    return 2\n",
    "python/windows_lines": "line1 = 1\r\nline2 = 2\r\n",
    "empty": "",
    "short": "x",
    "whitespace": " \t\n  \n",
    "empty_string_lit": 's = ""\n',
    "math/equation": "E = m c^2\nF = G m1 m2 / r^2\n",
    "math/fraction": "y = (a + b) / (c - d)\n",
    "math/exponent": "σ = 1.2e-3\nN = 6.022e23\n",
    "math/ops": "∇·E = ρ/ε0\n∂u/∂t + u·∇u = -∇p + ν∇²u\n",
    "math/vars": "let x_i = Σ_j A_{ij} v_j\n",
    "math/unicode": "∫_0^∞ e^{-x} dx = 1\nα + β = γ\n",
    "stem/prose": "The Reynolds number Re = ρ U L / μ is dimensionless.\n",
    "stem/units": "c = 2.99792458e8 m/s\nPlanck's constant h = 6.62607015e-34 J s\n",
    "stem/formula": "ΔG = ΔH - T ΔS\n",
    "stem/unicode": "The wavelength λ = 550 nm. Temperature θ ≈ 300 K. Vector â.\n",
    "stem/mixed": "Compute RMSE for predictions in Python:\nrmse = ((y_hat - y) ** 2).mean() ** 0.5  # units: Kelvin\n",
    "edge/ascii": "The quick brown fox jumps over the lazy dog 0123456789.\n",
    "edge/unicode": "你好世界 — café — naïve — Москва — عربي — 🙂\n",
    "edge/punctuation": "!@#$%^&*()[]{}<>/\\|`~;:,.?\n",
    "edge/long": "def long(" + ", ".join(f"arg_{i}: int" for i in range(40)) + ") -> int:\n    return 0\n",
    "edge/quotes": "He said, \"n='ok'\" and left.\n",
    "edge/nullish": "zero\x00byte and \x7f\n",
}

# Word lists of the synthetic training lines, and the texts that exercise byte fallback.
LINE_KEYWORDS = ("def", "class", "return", "import", "from", "async", "await", "yield", "except", "finally")
LINE_STEMS = ("compute", "normalize", "estimate", "residual", "gradient", "tensor", "matrix", "solver", "energy", "momentum")
FALLBACK = ("🙂🔥✨", "한글テスト", "Ω≈åß∂ƒ", "\x00\x01\x02þÿ", "é" * 32, "á", "☃️", "𐍈")


def evaluation(spark: SparkSession) -> DataFrame:
    """``name, text, ord`` of the evaluation corpus."""
    return spark.createDataFrame([(n, t, k) for k, (n, t) in enumerate(EVALUATION.items())], "name string, text string, ord int")


def synthetic(i: int) -> str:
    """Training text number ``i``; a function of the number alone."""
    x = f"x_{i % 17}"
    value = f"{i % 997 + 1}.{7 * i % 1000}e{i % 9 - 4}"
    out = [
        f"{LINE_KEYWORDS[i % 10]} {LINE_STEMS[i % 10]}_{i}_value({x}: float) -> float:",
        f"    y = {x} * {value} + {i % 13}",
        "    if y == 0 or y != y:",
        "        return 0.0",
        "    return y ** 2 // 1",
    ]
    if not i % 11:
        out.append(f"    # unit: kg m / s^2  λ={i}  Δ={i % 5}")
    if not i % 19:
        out += ["from typing import Optional, Sequence", "import math"]
    return "\n".join(out) + "\n"


def training(extra_lines: int = 4000) -> list[str]:
    return [*EVALUATION.values(), *map(synthetic, range(extra_lines))]


def training_table(spark: SparkSession, extra_lines: int = 4000) -> DataFrame:
    """``ord, text`` of the training texts."""
    return spark.createDataFrame(list(enumerate(training(extra_lines))), "ord int, text string")


def corpus_hash(texts: list[str]) -> str:
    """sha256 over the version and the length-prefixed texts, in order."""
    h = hashlib.sha256(CORPUS_VERSION.encode())
    for t in texts:
        raw = t.encode()
        h.update(len(raw).to_bytes(8, "little") + raw)
    return h.hexdigest()


def bundle(extra_lines: int = 4000) -> dict:
    """The whole fixed corpus with its hashes: ``version, evaluation, training, evaluation_hash, training_hash``."""
    texts = training(extra_lines)
    return {"version": CORPUS_VERSION, "evaluation": list(EVALUATION.items()), "training": texts, "evaluation_hash": corpus_hash(list(EVALUATION.values())), "training_hash": corpus_hash(texts)}
