"""Model search space (A88, A89): seeded draws over the nine parameter ranges.

A draw is a function of (seed, key, number, parameter): the first 32 bits of an
MD5, so every engine and every rerun draws the same candidates and no state is
kept.  Integers are uniform over the closed range, reals uniform or log-uniform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameter, kind, low, high.
SEARCH_SPACE = [
    ("n_estimators", "integer", 300, 800),
    ("max_depth", "integer", 3, 10),
    ("learning_rate", "log-uniform", 0.01, 0.2),
    ("subsample", "uniform", 0.7, 1.0),
    ("colsample_bytree", "uniform", 0.7, 1.0),
    ("gamma", "uniform", 0, 5.0),
    ("reg_alpha", "log-uniform", 1e-4, 1.0),
    ("reg_lambda", "log-uniform", 0.1, 5),
    ("min_child_weight", "integer", 1, 10),
]


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts' text."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def draws(keys: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` candidates per key, one row each with a column per parameter."""
    rows = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    out = {}
    for name, kind, low, high in SEARCH_SPACE:
        u = unit_draw(F.lit(seed), F.col(key), F.col("draw"), F.lit(name))
        if kind == "integer":
            out[name] = (F.floor(u * (high - low + 1)) + low).cast("double")
        elif kind == "uniform":
            out[name] = F.lit(float(low)) + u * F.lit(float(high) - float(low))
        else:
            out[name] = F.lit(float(low)) * F.pow(F.lit(float(high) / float(low)), u)
    return rows.withColumns(out)


def range_summary(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The bounds of each parameter's range (``low``, ``high``), and the
    smallest and largest value that was drawn from it."""
    names = [p[0] for p in SEARCH_SPACE]
    long = candidates.unpivot(keys, names, "parameter", "value")
    low, high = (F.create_map(*[x for p in SEARCH_SPACE for x in (F.lit(p[0]), F.lit(float(p[i])))]) for i in (2, 3))
    drawn = long.groupBy(*keys, "parameter").agg(F.min("value").alias("drawn_low"), F.max("value").alias("drawn_high"))
    return drawn.select(*keys, "parameter", F.element_at(low, F.col("parameter")).alias("low"),
                        F.element_at(high, F.col("parameter")).alias("high"), "drawn_low", "drawn_high")
