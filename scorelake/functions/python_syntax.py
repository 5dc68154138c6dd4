"""Python syntax check: the one static signal that needs a Python parser."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def python_parses(code: Column) -> Column:
    """Whether the text is valid Python; NULL for NULL and for unreadable text.

    The functions are local so that they travel to the executors by value.
    """

    def parses(text):
        if text is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        except SyntaxError:
            return False
        except (ValueError, RecursionError, MemoryError):
            return None
        return True

    def batch(texts: pd.Series) -> pd.Series:
        # Models repeat themselves: each distinct text of a batch is parsed once.
        verdicts = {t: parses(t) for t in texts.unique()}
        return pd.Series([verdicts[t] for t in texts], dtype=object)

    return F.pandas_udf(batch, T.BooleanType())(code)
