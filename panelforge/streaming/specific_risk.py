"""The specific-volatility recursion over a stream of residuals, with its state kept by entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id long, date date, vol double"
STATE = "count long, squares double, variance double, previous double"


def specific_volatility_stream(res: DataFrame, seed: int = 63, half_life: float = 84.0) -> DataFrame:
    """(id, date, vol) for each residual of a stream (id, date, res), before it is known, as the batch operator gives
    it. Each micro-batch must hold later dates of an entity than the ones before; inside one they are sorted."""
    decay = 0.5 ** (1.0 / half_life)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, squares, variance, previous = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("date")
        vols = []
        for x in rows["res"]:
            if count > seed:
                variance = decay * variance + (1 - decay) * previous**2
            vols.append(np.sqrt(variance) if count >= seed else None)
            if count < seed:
                squares += x * x
                if count == seed - 1:
                    variance = squares / max(1, seed - 1)
            previous, count = x, count + 1
        state.update((count, squares, variance, previous))
        yield pd.DataFrame({"id": rows["id"], "date": rows["date"], "vol": vols})

    return res.groupBy("id").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
