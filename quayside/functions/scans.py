"""Running quantities, as-of and interval joins over long keys.

One key can hold months of ticks, so no window here spans a whole key.  A key is cut into
buckets; windows run inside a bucket, each bucket is summed up in one row, and the
summaries, few as they are, carry what came before into the next buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """A repeatable draw in [0, 1) from the parts' text."""
    cols = [F.lit(p) if not isinstance(p, Column) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with running columns: specs {name: (kind, value)}, kind sum, max, count or last (last value that isn't null);
    with ``<`` at the end of the kind the row itself doesn't count.

    ``bucket`` must not fall along ``order``; ties of ``order`` must not matter or not exist.
    """
    tmp = {out: f"__v_{out}" for out in specs}
    b = df.withColumn("__bucket", bucket).withColumns({tmp[o]: v for o, (_, v) in specs.items()})
    along = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    local, summed, carried, result = {}, [], {}, {}
    for out, (kind, _) in specs.items():
        v, s, c = F.col(tmp[out]), f"__s_{out}", f"__c_{out}"
        inside = along.rowsBetween(Window.unboundedPreceding, -1 if kind.endswith("<") else 0)
        kind = kind.rstrip("<")
        if kind == "last":
            local[f"__l_{out}"] = F.last(v, True).over(inside)
            summed.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(s))
            carried[c] = F.last(s, True).over(before)
            result[out] = F.coalesce(f"__l_{out}", c)
        elif kind == "max":
            local[f"__l_{out}"] = F.max(v).over(inside)
            summed.append(F.max(v).alias(s))
            carried[c] = F.max(s).over(before)
            result[out] = F.greatest(f"__l_{out}", c)
        else:
            f = F.sum if kind == "sum" else F.count
            local[f"__l_{out}"] = f(v).over(inside)
            summed.append(f(v).alias(s))
            carried[c] = F.sum(s).over(before)
            result[out] = F.coalesce(f"__l_{out}", F.lit(0)) + F.coalesce(c, F.lit(0))
    carry = b.groupBy(*keys, "__bucket").agg(*summed).withColumns(carried).select(*keys, "__bucket", *carried)
    out = b.withColumns(local).join(carry, [*keys, "__bucket"]).withColumns(result)
    return out.select(*df.columns, *specs)


def asof_scan(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, specs: dict[str, tuple[str, Column]], bucket_ns: int, tie: str | None = None) -> DataFrame:
    """``left`` with running columns over the rows of ``right`` at or before ``left_ts``, all in one scan; specs as in
    ``prefix_scan``, values over the columns of ``right``; ``tie`` orders right rows of one instant."""
    l_cols = [c for c in left.columns if c not in on]
    lhs = left.select(*on, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.struct(*l_cols).alias("__row"))
    r = right.select(
        *on, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("__tie"), *[v.alias(f"__in_{o}") for o, (_, v) in specs.items()])
    both = lhs.unionByName(r, allowMissingColumns=True)
    seen = prefix_scan(both, on, ["__t", "__side", "__tie"], F.floor(F.col("__t") / bucket_ns), {o: (kind, F.col(f"__in_{o}")) for o, (kind, _) in specs.items()})
    return seen.where("__side = 1").select(*on, *[F.col(f"__row.{c}").alias(c) for c in l_cols], *specs)


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, cols: Sequence[str], bucket_ns: int, tie: str | None = None) -> DataFrame:
    """``left`` with ``cols`` of the last row of ``right`` at or before ``left_ts``; ``tie`` orders right rows of one instant."""
    seen = asof_scan(left, right, on, left_ts, right_ts, {"__as_of": ("last", F.struct(*cols))}, bucket_ns, tie)
    return seen.select(*left.select(*on).columns, *[c for c in left.columns if c not in on], *[F.col(f"__as_of.{c}").alias(c) for c in cols])


def lagged(df: DataFrame, keys: Sequence[str], ts: str, step: int, lags: dict[str, tuple[str, int]]) -> DataFrame:
    """``df``, whose rows of a key lie ``step`` apart in ``ts``, with {name: (column, k)}: the column k steps before, null
    where there is no such row.

    Each row sends its values to the rows that look back at it; one grouping by (key, ts) brings them together,
    so a long key is spread over all tasks.
    """
    by_k: dict[int, dict[str, str]] = {}
    for name, (column, k) in lags.items():
        by_k.setdefault(k, {})[name] = column
    here = [c for c in df.columns if c not in keys and c != ts]
    sent = df.withColumn("__k", F.explode(F.array(F.lit(0), *[F.lit(k) for k in by_k])))
    own = F.max(F.when(F.col("__k") == 0, F.struct(F.lit(1).alias("__is"), *here))).alias("__own")
    back = [F.max(F.when(F.col("__k") == k, F.col(column))).alias(name) for k, named in by_k.items() for name, column in named.items()]
    met = sent.groupBy(*keys, (F.col(ts) + F.col("__k") * step).alias(ts)).agg(own, *back).where("__own is not null")
    return met.select(*keys, ts, *[F.col(f"__own.{c}").alias(c) for c in here], *lags)


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, rows: int, columns: dict[str, Callable[[WindowSpec], Column]], size: int = 4096) -> DataFrame:
    """``df`` with columns over frames of at most ``rows`` rows that end at the row itself: {name: window -> column}; the window
    is ordered and has no frame yet.

    Rows are numbered and cut into blocks of ``size``; the last ``rows`` - 1 of a block also go to the next one, where
    they only serve as history.  So no task holds more than a block of a key.
    """
    size = max(size, rows)
    n = prefix_scan(df, keys, order, bucket, {"__n": ("count", F.lit(1))}).withColumn("__n", F.col("__n") - 1)
    block = F.expr(f"__n DIV {size}")
    goes_on = F.col("__n") % size > size - rows
    n = n.withColumn("__block", F.explode(F.when(goes_on, F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy(*keys, "__block").orderBy("__n")
    out = n.withColumns({name: make(w) for name, make in columns.items()})
    return out.where(F.col("__block") == block).select(*df.columns, *columns)


def interval_join(points: DataFrame, spans: DataFrame, on: Sequence[str], ts: str, lo: str, hi: str, bucket_ns: int, lo_open: bool = True, hi_open: bool = False) -> DataFrame:
    """Pairs of a point and a span of the same key that holds it: a hash join on time buckets, then the exact bounds."""
    p = points.withColumn("__bucket", F.floor(F.col(ts) / bucket_ns))
    s = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(lo) / bucket_ns), F.floor(F.col(hi) / bucket_ns))))
    t, a, b = F.col(ts), F.col(lo), F.col(hi)
    held = ((t > a) if lo_open else (t >= a)) & ((t < b) if hi_open else (t <= b))
    return p.join(s, [*on, "__bucket"]).where(held).drop("__bucket")


def ewma(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, alpha: float | Column, x: str, out: str, seed_zero: bool = False,
    count: str | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
    """``df`` with the exponentially weighted mean of ``x``: the first value seeds it (or 0 with
    ``seed_zero``, when the first value only starts the count), null leaves it as it is.

    ``count`` names a column for the number of values so far.  ``alpha`` may be a column that is constant in a key;
    ``bounds`` then has its smallest and largest value.  Inside a bucket of values the recurrence is a weighted running
    sum; bucket lengths keep the weights within twelve digits, and as many buckets are carried as have a weight left.
    """
    slow, fast = bounds or (alpha, alpha)
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    size = max(1, min(4000, int(12 * math.log(10) / -math.log(1 - fast))))
    carried = max(1, math.ceil(16 * math.log(10) / -math.log(1 - slow) / size))
    n = count or f"__n_{out}"
    counted = prefix_scan(df, keys, order, bucket, {n: ("count", F.col(x))})
    value = counted.where(F.col(x).isNotNull()).select(*keys, n, F.col(x).alias("__x"), (1 - alpha).alias("__keep")).withColumn("__i", F.col(n) - 1)
    value = value.withColumn("__b", F.floor(F.col("__i") / size)).withColumn("__j", F.col("__i") % size)
    first, keep = F.lit(0.0) if seed_zero else F.col("__x"), F.col("__keep")
    y = F.when(F.col("__i") == 0, first).otherwise(F.col("__x") * (1 - keep))
    inside = Window.partitionBy(*keys, "__b").orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
    value = value.withColumn("__local", F.pow(keep, F.col("__j")) * F.sum(y * F.pow(keep, -F.col("__j"))).over(inside))
    along = Window.partitionBy(*keys).orderBy("__b").rowsBetween(-carried, -1)
    ends = value.groupBy(*keys, "__b").agg(F.max_by("__local", "__j").alias("__end"), F.first("__keep").alias("__q"))
    # buckets before the current one are full
    folded = F.aggregate(F.collect_list("__end").over(along), F.lit(0.0), lambda m, e: m * F.pow(F.col("__q"), F.lit(size)) + e)
    carry = ends.withColumn("__carry", folded).select(*keys, "__b", "__carry")
    mean = value.join(carry, [*keys, "__b"]).select(*keys, n, (F.col("__local") + F.pow(keep, F.col("__j") + 1) * F.col("__carry")).alias(out))
    return counted.join(mean, [*keys, n], "left").select(*df.columns, *([count] if count else []), out)


def non_overlapping(df: DataFrame, key: str, row: str, start: str, end: str, written, bucket: int) -> DataFrame:
    """Rows that a greedy pass takes: per key the first by (start, row), then always the next whose start is
    not before the end of the one taken.

    Each row points to the row taken after it; doubling the pointers log2(rows) times marks all
    that the first row reaches.  ``row`` is a number; ``written`` cuts the lineage of the few columns
    used; ``bucket`` is the length of the time buckets.
    """
    rows = written(df.select(key, row, start, end))
    starts = rows.select(key, F.col(start).alias("__t"), F.lit(1).alias("__side"), F.col(row), F.col(row).alias("__me"))
    ends = rows.select(key, F.col(end).alias("__t"), F.lit(0).alias("__side"), F.col(row), F.lit(None).cast(starts.schema["__me"].dataType).alias("__me"))
    # the next start after an end is the last one seen when time runs backwards
    back = starts.unionByName(ends).withColumns({"__bt": -F.col("__t"), "__bs": -F.col("__side"), "__br": -F.col(row)})
    seen = prefix_scan(back, [key], ["__bt", "__bs", "__br"], F.floor(F.col("__bt") / bucket), {"__next": ("last", F.col("__me"))})
    jumps = seen.where("__side = 0 and __next is not null").select(key, F.col(row).alias("a"), F.col("__next").alias("b"))
    jumps = written(jumps)
    taken = written(rows.groupBy(key).agg(F.min_by(row, F.struct(start, row)).alias("a")))
    n = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < n:
        reached = taken.join(jumps, [key, "a"]).select(key, F.col("b").alias("a"))
        taken = written(taken.unionByName(reached).distinct())
        jumps = written(jumps.join(jumps.select(key, F.col("a").alias("b"), F.col("b").alias("c")), [key, "b"]).select(key, "a", F.col("c").alias("b")))
        step *= 2
    return taken.select(key, F.col("a").alias(row))
