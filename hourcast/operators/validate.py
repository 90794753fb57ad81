"""Row validation with rule outcomes.

Every rule is a Column; a row's failed rules are collected into one array
(``violations``) in rule order, and routing reads that array.  No rule ever
leaves the JVM, so validation fuses into the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Driver-side schema check; the error lists the missing set, sorted."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def require_rows(df: DataFrame, what: str = "dataset") -> DataFrame:
    """Fail fast on an empty input (``isEmpty`` reads at most one row)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def violations(rules: list[tuple[str, Column]]) -> Column:
    """Names of the failed rules, in order (``rules`` = (name, failed?))."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]),
                    lambda x: x.isNotNull())


# Severities of the contract outcomes.
QUARANTINE = "quarantine"
WARNING = "warning"


def route(df: DataFrame, quarantine_rules: list[tuple[str, Column]],
          warning_rules: list[tuple[str, Column]]) -> DataFrame:
    """Accepted / quarantined / warned, with the reasons kept."""
    q = violations(quarantine_rules)
    w = violations(warning_rules)
    out = df.withColumns({"quarantine_reasons": q, "warning_reasons": w})
    return out.withColumn(
        "route", F.when(F.size("quarantine_reasons") > 0, F.lit("quarantined"))
        .when(F.size("warning_reasons") > 0, F.lit("warned")).otherwise(F.lit("accepted")))


def route_levels(df: DataFrame, levels: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    """``route`` = the first level (most severe first) with a failed rule,
    else ``accepted``; ``reasons`` = all failed rules in order."""
    failed = {name: violations(rules) for name, rules in levels.items()}
    route = None
    for name, v in failed.items():
        route = F.when(F.size(v) > 0, F.lit(name)) if route is None else route.when(F.size(v) > 0, F.lit(name))
    return df.withColumns({"route": route.otherwise(F.lit("accepted")), "reasons": F.concat(*failed.values())})


def parameter_gate(start: Column, end: Column, ratio: Column, grid: Column) -> Column:
    """Percent bounds, start not after end (equal is allowed), test ratio and grid size."""
    return violations([
        ("percent_bounds", (start < 0) | (start > 100) | (end < 0) | (end > 100)), ("start_after_end", start > end),
        ("test_ratio", (ratio <= 0) | (ratio >= 0.95)), ("grid", grid < 0)])


def schema_diff(df: DataFrame, contract: list[tuple[str, str, bool]]) -> list[tuple[str, str]]:
    """Compare a frame's schema with a contract ``(name, type, required)``.

    Missing required field or wrong type -> ``block``; extra field ->
    ``warning``.  Schemas are metadata, so this runs on the driver.
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for name, typ, required in contract:
        if name not in actual:
            if required:
                out.append((name, "block:missing"))
        elif actual[name] != typ:
            out.append((name, "block:type"))
    declared = {c[0] for c in contract}
    out += [(name, "warning:extra") for name in sorted(actual) if name not in declared]
    return out


def parse_count(text: Column) -> Column:
    """C4: numeric count text -> bigint (null when not numeric)."""
    return text.try_cast(T.LongType())
