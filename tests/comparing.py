"""Comparison of results without regard to order."""

import math

import pandas as pd


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if hasattr(x, "item"):
        return cell(x.item())
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    return str(x)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False, name=None))


def same(spark_frame, duck_relation):
    left, right = spark_frame.toPandas(), duck_relation.df()
    assert sorted(left.columns) == sorted(right.columns)
    assert rows_of(left) == rows_of(right)
