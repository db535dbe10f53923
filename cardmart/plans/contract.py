"""Contracts: what a dataset needs, how it is checked and how it is published."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, sinks
from ..sources.readers import read_table_or_path


@dataclass(frozen=True)
class Contract:
    name: str
    builder: Callable[..., DataFrame]
    schema: dict[str, str]
    keys: tuple[str, ...]
    mode: str = "overwrite"
    options: dict = field(default_factory=dict)
    sources: tuple[str, ...] = ()
    depends: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    warn_only: tuple[str, ...] = ()
    #: Against an input, by name: the greatest share of rows that may be lost (per cent), and measures whose sums must agree (within an absolute tolerance).
    row_loss: dict[str, float] = field(default_factory=dict)
    sums: dict[str, dict[str, float]] = field(default_factory=dict)
    #: A time column and how many minutes old its newest value may be.
    fresh: tuple[str, int] | None = None
    ranges: dict[str, tuple] = field(default_factory=dict)
    accepted: dict[str, tuple] = field(default_factory=dict)


class GateError(RuntimeError):
    """A critical check failed; nothing was published."""


def _totals(df: DataFrame, measures: Sequence[str]) -> dict:
    """Row count and sums in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.sum(m).cast("double").alias(f"sum_{m}") for m in measures)).first().asDict()


def audit(df: DataFrame, contract: Contract, inputs: dict[str, DataFrame] | None = None, now: dt.datetime | None = None) -> list[tuple[str, bool, str]]:
    """check, passed, detail: schema; emptiness, nulls, ranges and accepted values in one pass; unique keys; freshness; rows and sums against the inputs, one pass each."""
    problems = checks.schema_problems(df, contract.schema)
    out = [("schema", not problems, "; ".join(problems))]
    if problems:
        return out
    m = checks.metrics(df, [*contract.keys, *contract.required], contract.ranges, contract.accepted).first().asDict()
    out.append(("not_empty", m["row_count"] > 0, str(m["row_count"])))
    out += [(k, v == 0, str(v)) for k, v in m.items() if k.startswith(("null_", "range_", "accepted_"))]
    out.append(("unique", checks.duplicated(df, contract.keys).isEmpty(), ",".join(contract.keys)))
    if contract.fresh:
        late = checks.freshness(df, contract.fresh[0], now or dt.datetime.now(dt.UTC).replace(tzinfo=None), contract.fresh[1]).first()
        out.append(("fresh", late is None, "" if late is None else f"{late['lag_minutes']} minutes"))
    for name in dict.fromkeys([*contract.row_loss, *contract.sums]):
        measures = contract.sums.get(name, {})
        there, here = _totals((inputs or {})[name], list(measures)), _totals(df, list(measures))
        if name in contract.row_loss:
            lost = checks.row_loss(there["rows"], here["rows"], contract.row_loss[name])
            out.append((f"row_loss_{name}", lost is None, lost or ""))
        for c, tolerance in measures.items():
            x, y = there[f"sum_{c}"] or 0.0, here[f"sum_{c}"] or 0.0
            out.append((f"sum_{c}_{name}", checks.within(x, y, tolerance), f"{x} and {y}"))
    return out


def build(spark: SparkSession, contract: Contract, base: str, paths: dict[str, str], built: dict[str, DataFrame] | None = None, audit_path: str | None = None, run: str | None = None) -> DataFrame:
    """Build a dataset, write it to staging, audit the written rows and publish them; returns what was staged.

    Dependencies come from `built` or from where they are published.
    """
    built = built or {}
    inputs = [read_table_or_path(spark, paths[s]) for s in contract.sources]
    inputs += [built[d] if d in built else read_table_or_path(spark, f"{base}/{d}") for d in contract.depends]
    staging = f"{base}/_staging/{contract.name}-{uuid.uuid4().hex}"
    df = contract.builder(*inputs)
    checks.require_columns(df, list(contract.schema))
    sinks.overwrite(df.select(*contract.schema), staging)
    staged = spark.read.parquet(staging)
    results = audit(staged, contract, dict(zip((*contract.sources, *contract.depends), inputs, strict=True)))
    if audit_path:
        today = dt.date.today().isoformat()
        sinks.log_audit(spark, [("cardmart", contract.name, n, "warn" if n in contract.warn_only else "critical", ok, d, run or "", today) for n, ok, d in results], audit_path)
    if bad := [f"{n}: {d}" for n, ok, d in results if not ok and n not in contract.warn_only]:
        raise GateError(f"{contract.name}: {', '.join(bad)}")
    sinks.write(staged, contract.mode, f"{base}/{contract.name}", **contract.options)
    return staged


def in_order(contracts: Sequence[Contract]) -> list[Contract]:
    """Contracts such that each comes after those that it depends on; ValueError on a cycle. Dependencies outside the list are taken as published."""
    by_name, done, out = {c.name: c for c in contracts}, set(), []
    while len(out) < len(contracts):
        ready = [c for c in contracts if c.name not in done and all(d in done or d not in by_name for d in c.depends)]
        if not ready:
            raise ValueError(f"contracts depend on each other: {', '.join(sorted(set(by_name) - done))}")
        out += ready
        done |= {c.name for c in ready}
    return out


def build_all(spark: SparkSession, contracts: Sequence[Contract], base: str, paths: dict[str, str], audit_path: str | None = None, run: str | None = None) -> dict[str, str]:
    """Build datasets in order of dependency: published, failed (with why), or skipped where one that it needs was not published."""
    built: dict[str, DataFrame] = {}
    told: dict[str, str] = {}
    for c in in_order(contracts):
        if missing := [d for d in c.depends if d in told and d not in built]:
            told[c.name] = f"skipped: needs {', '.join(missing)}"
            continue
        try:
            built[c.name] = build(spark, c, base, paths, built, audit_path, run)
            told[c.name] = "published"
        except GateError as e:
            told[c.name] = f"failed: {e}"
    return told
