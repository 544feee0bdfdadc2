"""The hook for text encoders; none is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encoded(rows: DataFrame, item: str, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(item, x): unit vectors of whole texts by the encoder that `make` returns, made once per task.

    The encoder takes a list of texts and returns a matrix. Null texts are read as empty ones; a zero
    vector stays zero.
    """
    kind = dict(rows.dtypes)[item]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for batch in batches:
            if len(batch):
                x = np.asarray(encoder(batch["text"].fillna("").tolist()), dtype=np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"item": batch["item"], "x": list(x)})

    given = rows.select(F.col(item).alias("item"), F.col(text).alias("text"))
    return given.mapInPandas(encode, f"item {kind}, x array<double>").withColumnRenamed("item", item)
