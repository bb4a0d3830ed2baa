"""The functions as DataFrame transforms, without formulas: panel.transform(using("ts_corr", "x", "y", 20, to="c")).

Each call adds one column; Catalyst plans the whole chain, puts projections together, and shares shuffles and sorts among
calls that ask for the same ones.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .registry import OPS, Whole


def using(name: str, *args: str | Column | float | int | bool | None, to: str, **named) -> Callable[[DataFrame], DataFrame]:
    """A transform of panel(date, di, sym, fields) that adds the function's result as `to`. Columns, by name or as
    expressions, come first, constants after them, parameters also by name."""
    made = OPS[name]

    def run(panel: DataFrame) -> DataFrame:
        out = made.build(*(F.col(a) if isinstance(a, str) else a for a in args), **named)
        if not inspect.isgenerator(out):
            return panel.withColumn(to, out)
        df, sent, n = panel, None, 0
        try:
            while True:
                asked = out.send(sent)
                names = {k: f"_{to}_{n + i}" for i, k in enumerate(asked)}
                n += len(asked)
                df = df.withColumns({names[k]: c for k, c in asked.items() if not isinstance(c, Whole)})
                whole = {k: c for k, c in asked.items() if isinstance(c, Whole)}
                if whole:  # one row for the whole panel
                    df = df.crossJoin(F.broadcast(df.agg(*(c.value.alias(names[k]) for k, c in whole.items()))))
                sent = {k: F.col(c) for k, c in names.items()}
        except StopIteration as e:
            return df.withColumn(to, e.value).drop(*(f"_{to}_{k}" for k in range(n)))

    return run
