"""Checks and choices of columns, made before a job runs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import prefix_scan


def label_columns(horizons: Iterable[float], passive: bool = True) -> list[str]:
    """Names of all label columns that a configuration produces."""
    sides, hs = ("long", "short"), [f"{h:g}" for h in horizons]
    out = ["t_entry_ns", *[f"{c}_{s}" for s in sides for c in ("entry_px", "qty", "slip_bps")], *[f"hold_ms_{h}" for h in hs]]
    out += [f"{c}_{s}_{h}" for s in sides for h in hs for c in ("ret", "gross", "fund", "mae")]
    if passive:
        out += [f"{c}_{s}" for s in sides for c in ("ppx", "pfill", "pwait_ms")] + [f"pret_{s}_{h}" for s in sides for h in hs]
    return out


def matching_columns(columns: Iterable[str], prefix: str, most: float) -> list[str]:
    """Columns named ``prefix`` and a horizon of at most ``most``, by horizon."""
    found = [(float(m[1]), c) for c in columns if (m := re.fullmatch(re.escape(prefix) + r"(\d+(?:\.\d+)?)", c))]
    return [c for h, c in sorted(found) if h <= most]


def unknown_keys(given: dict, known: dict) -> list[str]:
    """Dotted keys of ``given`` that ``known`` doesn't have."""
    out = []
    for k, v in given.items():
        if k not in known:
            out.append(k)
        elif isinstance(v, dict) and isinstance(known[k], dict):
            out += [f"{k}.{x}" for x in unknown_keys(v, known[k])]
    return out


def missing_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in wanted if c not in have]


def pruned(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Keys and chosen features; what is missing is an error before the job runs."""
    if missing := missing_columns(df, [*keys, *features]):
        raise ValueError(f"no such columns: {missing}")
    return df.select(*keys, *features)


def time_window(df: DataFrame, ts: str, start: int, end: int) -> DataFrame:
    """Rows in [start, end)."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def purge_gap_ns(embargo_s: float, horizons_s: Iterable[float], latency_p99_ms: float, wait_s: float) -> int:
    """Time between windows in which a label of one could reach into the next: the longest horizon, both latencies, the wait and ten seconds, or the embargo if that is longer."""
    return int(max(embargo_s, max(horizons_s) + 2 * latency_p99_ms / 1e3 + wait_s + 10.0) * 1e9)


def training_rows(df: DataFrame, valid: str, labels: list[str], most: int, ts: str, key: str, bucket_ns: int) -> DataFrame:
    """Valid rows with any label; every k-th of them along (ts, key), k the least that leaves ``most`` at most."""
    rows = df.where(F.col(valid) & F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in labels], F.lit(False)))
    k = max(1, math.ceil(rows.count() / most))
    n = prefix_scan(rows.withColumn("__one", F.lit(1)), ["__one"], [ts, key], F.floor(F.col(ts) / bucket_ns), {"__n": ("count", F.lit(1))})
    return n.where((F.col("__n") - 1) % k == 0).select(*df.columns)


def dataset_order(df: DataFrame, ts: str, key: str) -> DataFrame:
    """The stable order of a dataset: by time, then by key."""
    return df.orderBy(ts, key)
