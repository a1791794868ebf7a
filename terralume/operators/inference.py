"""Detectors as functions of a tile: the place where a network goes, which this engine has none of."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_scores(pixels: DataFrame, bands: list[str], tile: int, model: Callable[[dict[str, np.ndarray]], float], keys=()) -> DataFrame:
    """(keys, tx, ty, probability) of each tile: the model gets the tile's bands as arrays, NaN where a pixel is missing.

    A tile is one group of at most ``tile`` x ``tile`` pixels.
    """
    names = [*keys, "tx", "ty"]
    placed = pixels.select(*keys, *[F.floor(F.col(a) / float(tile)).alias(f"t{a}") for a in ("x", "y")], "x", "y", *bands)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["y"].to_numpy() % tile, pdf["x"].to_numpy() % tile
        arrays = {}
        for b in bands:
            arrays[b] = np.full((tile, tile), np.nan)
            arrays[b][at] = pdf[b]
        return pd.DataFrame([{**pdf.iloc[0][names].to_dict(), "probability": model(arrays)}])

    schema = ", ".join([*[f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in names], "probability double"])
    return placed.groupBy(*names).applyInPandas(one, schema)
