"""Python syntax test as an Arrow UDF, shared by the quality rules and the rubric."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def parses(code: str | None) -> bool:
    """Whether the text is Python; texts the parser gives up on (NUL, nesting, memory) are not."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(code or "")
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False
    return True


@F.pandas_udf(BooleanType())
def _python_parses(code: pd.Series) -> pd.Series:
    return code.map(parses)


def python_parses(code: Column) -> Column:
    return _python_parses(code)
