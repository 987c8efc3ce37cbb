"""Unicode normalization: Spark has no built-in, so an Arrow UDF does it."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_unicode(df: DataFrame, columns: list[str], form: str = "NFC") -> DataFrame:
    """``df`` with the named string columns in ``form`` (NFC or NFD)."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return df.withColumns({c: normal(c) for c in columns})
