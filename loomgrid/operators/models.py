"""The contract of model operators: a batch function on columns of arrays or bytes; no weights are bundled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Models of a worker process by (kind, reference, options); made once, used by all batches.
_CACHE: dict[tuple, object] = {}


def cached(key: tuple, make: Callable[[], object]) -> object:
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def evict(prefix: tuple = ()) -> int:
    """Forget the models whose key starts with ``prefix``; how many there were."""
    gone = [k for k in _CACHE if k[: len(prefix)] == prefix]
    for k in gone:
        del _CACHE[k]
    return len(gone)


def apply_model(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    outputs: str,
    *,
    key: tuple,
    batch: int = 32,
    cleanup: Callable[[], None] | None = None,
) -> DataFrame:
    """``df`` with the columns ``outputs`` that the model gives for each row, in batches of ``batch``.

    ``load`` returns a function from a batch to a frame with the output columns in row order; it runs
    once in a worker process. ``cleanup`` runs when a partition is done, whatever happened.
    """
    names = [part.split()[0] for part in outputs.split(",")]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = cached(key, load)
        try:
            for pdf in parts:
                for lo in range(0, len(pdf), batch):
                    piece = pdf.iloc[lo : lo + batch].reset_index(drop=True)
                    made = model(piece)
                    if len(made) != len(piece):
                        raise ValueError(f"the model gave {len(made)} rows for {len(piece)}")
                    yield pd.concat([piece, made.reset_index(drop=True)[names]], axis=1)
        finally:
            if cleanup:
                cleanup()

    return df.mapInPandas(run, f"{own}, {outputs}")
