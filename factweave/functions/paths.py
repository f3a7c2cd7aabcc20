"""Path functions of `plans.rewrite` as vectorised UDFs; they have no Column form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import rewrite


@F.pandas_udf(T.StringType())
def js_import(importer: pd.Series, old: pd.Series, new: pd.Series, specifier: pd.Series) -> pd.Series:
    return pd.Series([rewrite.js_import(*x) if None not in x else None for x in zip(importer, old, new, specifier, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def absolute(use: pd.Series, module: pd.Series) -> pd.Series:
    return pd.Series([rewrite.absolute(*x) if None not in x else None for x in zip(use, module, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def moved_use(use: pd.Series, module: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([rewrite.moved_use(*x) if None not in x else None for x in zip(use, module, old, new, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def parent_files(path: pd.Series) -> pd.Series:
    return pd.Series([rewrite.parent_files(x) if x is not None else None for x in path], dtype=object)


@F.pandas_udf(T.StringType())
def rewrite_rust(text: pd.Series, module: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([rewrite.rewrite_rust(*x) if None not in x else None for x in zip(text, module, old, new, strict=True)], dtype=object)
