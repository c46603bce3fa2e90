"""Cases of the third round's findings."""

import duckdb
import numpy as np
import pytest

from quayside import registry
from quayside.operators import feeds, risk, stats


@pytest.fixture
def con(tmp_path):
    def views(**tables):
        """Small tables as Parquet for a query, and as views of a DuckDB connection for its SQL."""
        c = duckdb.connect()
        for name, df in tables.items():
            df.toPandas().to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
            c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
        return c, str(tmp_path)

    return views


def against_sql(spark, c, folder, name):
    got = registry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    rows = lambda x: sorted(tuple(r) for r in x)
    assert rows(got.select(*columns).collect()) == rows(c.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall())


def test_threshold_candidates_at_whole_ranks_and_halves(spark, con):
    """ranks 3, 6 and 7 of eleven rows, and prices of 1.035 and 2.425."""
    lines = [(i, 1, 1, 1 + i % 3, q, x, 0.05 + i / 1000, 0.04, "A", s, f"1995-{1 + i}-02") for s in "OF" for i in range(11) for q, x in [(20.0, (1000 + 500 * i) * 20.0)]]
    lines += [(20 + i, 1, 1, 1, 1.0, x, 0.09, 0.01, "A", "H", f"1996-{1 + i}-02") for i, x in enumerate([1035.0, 2425.0, 1030.0, 2420.0, 1040.0, 2430.0])]
    t = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string")
    c, folder = con(lineitem=t.withColumn("l_shipdate", t["l_shipdate"].cast("timestamp")))
    against_sql(spark, c, folder, "threshold_candidates")


def test_sparse_raw_files_hold_a_day(spark, tmp_path):
    """F8: one file a day, and reading a span still gives the rows inside it only."""
    hour = 3_600_000_000_000
    t0 = 1_704_067_200_000_000_000
    rows = spark.range(72).selectExpr("'meta' AS venue", f"{t0} + id * {hour} AS ts_local_ns", f"{t0} + id * {hour} AS ts_wall_ns", "'c' AS conn_id", "concat('x', id) AS raw")
    feeds.write_raw(rows, f"{tmp_path}/raw", sparse=True)
    assert len(list((tmp_path / "raw").rglob("*.gz"))) == 3
    got = feeds.read_raw(spark, f"file://{tmp_path}/raw", ["meta"], t0 + 30 * hour, t0 + 50 * hour)
    assert sorted(r.raw for r in got.collect()) == sorted(f"x{i}" for i in range(30, 50))


def test_instrument_mapping_is_spread(spark):
    """the first fitting candidate and multiplier, and no aggregation by sorting or broadcast of the markets."""
    markets = spark.createDataFrame([("AB", 1.0, True, 9.0, None, True), ("K9", 2.0, True, 9.0, None, True), ("Z", None, True, 9.0, "OV", True)], "symbol string, last_price double, active boolean, volume double, override string, covered boolean")
    prices = spark.createDataFrame([("1000AB", 1000.0), ("AB", 5.0), ("1000000AB", 1.0), ("9", 0.002), ("OV", 1.0)], "candidate string, price double")
    out = risk.instrument_mapping(markets, prices)
    assert {r.symbol: (r.candidate, r.multiplier, r.reason) for r in out.collect()} == {"AB": ("1000AB", 1e-3, "ok"), "K9": ("9", 1e3, "ok"), "Z": (None, None, "no_price")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("size", [1, 2, 9, 6000])
def test_exact_quantiles_near_their_bounds(spark, size):
    """only values near a quantile are counted by value, whatever ties there are."""
    x = np.concatenate((np.random.default_rng(size).integers(0, 40, size) / 8, np.linspace(-1e6, 1e6, size)))
    qs = [0.0, 0.001, 0.1, 0.5, 0.9, 1.0]
    got = {r.q: r.value for r in stats.exact_quantiles(spark.createDataFrame([(float(v),) for v in x], "x double"), [], "x", qs).collect()}
    assert got == pytest.approx({q: np.quantile(x, q) for q in qs}, abs=1e-9)
