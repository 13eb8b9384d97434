"""Named batch models: user callables that turn rows into feature, depth or mask rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class BatchModel:
    """``load()`` runs once per Python worker and returns the function applied to each batch."""

    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    schema: str


MODELS: dict[str, BatchModel] = {}


def register(name: str, load: Callable, schema: str) -> None:
    MODELS[name] = BatchModel(load, schema)


def infer(df: DataFrame, name: str) -> DataFrame:
    """Run the named model over ``df`` in Arrow batches."""
    model = MODELS[name]
    load = model.load

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = load()
        for pdf in batches:
            yield apply(pdf)

    return df.mapInPandas(run, model.schema)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def load_letters():
    """Deterministic stand-in for a descriptor model: how often each small letter stands in the whole text, unit length."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf["text"].fillna("")
        counts = np.column_stack([texts.str.count(x) for x in "abcdefghijklmnopqrstuvwxyz"]).astype("float64").reshape(len(pdf), 26)
        return pd.DataFrame({"id": pdf["id"], "vec": list(unit(counts))})

    return apply


register("letters", load_letters, "id long, vec array<double>")
