"""Sizing, limits and choices as column expressions over candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread


def quantize_down(value: Column, decimals: Column) -> Column:
    """Floor to a lot of ``decimals`` digits, in decimal arithmetic."""
    k = F.pow(F.lit(10), decimals).cast("decimal(18,0)")
    return (F.floor(value.cast("decimal(28,10)") * k) / k.cast("double")).cast("double")


def quantize_price(value: Column, decimals: Column, buys: Column) -> Column:
    """Floor to a tick for buys, ceiling for sells."""
    k = F.pow(F.lit(10), decimals).cast("decimal(18,0)")
    v = value.cast("decimal(28,10)") * k
    return F.when(buys, F.floor(v)).otherwise(F.ceil(v)).cast("double") / k.cast("double")


def min_feasible_qty(min_base: Column, min_quote: Column, price: Column, decimals: Column) -> Column:
    lot = F.pow(F.lit(10.0), -decimals)
    return F.round(F.ceil(F.greatest(min_base, min_quote / price) / lot - 1e-9) * lot, 10)


def drawdown_multiplier(equity: Column, peak: Column, begin: float, halt: float) -> Column:
    """1 until the fall from the peak reaches ``begin``, then linear down to 0 at ``halt``."""
    fall = 1 - equity / peak
    return F.when((peak <= 0) | (fall <= begin), 1.0).when(fall >= halt, 0.0).otherwise((halt - fall) / (halt - begin))


def margin_state(required: Column, equity: Column, warn: float, reduce: float) -> Column:
    return F.when((equity <= 0) | (required / equity >= reduce), "reduce").when(required / equity >= warn, "warn").otherwise("ok")


def kelly_size(df: DataFrame, kappa: float, z: float, f_max: float, loss_share: float) -> DataFrame:
    """``df`` (equity, mu, se, sd, es, price, decimals, min_qty) with fraction, qty and size_reason.

    The growth fraction uses the lower bound of the edge; the cap of loss keeps a bad outcome below
    ``loss_share`` of the equity; a size below the exchange's minimum is lifted only if that stays
    within the caps and the bound stays positive.
    """
    c = F.col
    lcb = c("mu") - z * c("se")
    f = F.least(kappa * lcb / (c("sd") * c("sd")), F.lit(f_max), loss_share / F.abs("es"))
    sized = df.withColumn("fraction", F.when((lcb > 0) & (c("sd") > 0) & (c("es") < 0), f).otherwise(0.0))
    raw = quantize_down(c("fraction") * c("equity") / c("price"), c("decimals"))
    cap = F.least(F.lit(f_max), loss_share / F.abs("es")) * c("equity") / c("price")
    lifted = (raw < c("min_qty")) & (c("min_qty") <= cap) & (c("fraction") > 0)
    qty = F.when(c("fraction") <= 0, 0.0).when(raw >= c("min_qty"), raw).when(lifted, c("min_qty")).otherwise(0.0)
    reason = (
        F.when(c("equity") <= 0, "no_free_equity").when((c("sd") <= 0) | (c("es") >= 0), "invalid_risk_estimate").when(lcb <= 0, "ev_lcb_not_positive")
        .when(raw >= c("min_qty"), "ok").when(lifted, "raised_to_exchange_minimum").otherwise("below_exchange_minimum"))
    return sized.withColumn("qty", qty).withColumn("size_reason", reason)


def account_leverage(max_gross: Column, market_max: Column) -> Column:
    """The account's setting: the gross cap rounded up, at least 1 and at most what the market allows."""
    return F.greatest(F.lit(1.0), F.least(market_max, F.ceil(max_gross).cast("double")))


def allocate(
    df: DataFrame, *, reserve: float, kappa: float, z: float, min_lcb: float, position_cap: float, gross_cap: float, margin_cap: float, loss_share: float, max_notional: float) -> DataFrame:
    """``df`` with leverage, fraction, qty and size_reason: fractional growth on the lower bound of the edge less the covariance
    with open positions, under five caps.

    ``df``: equity, side, mu, se, sd, es, price, decimals, min_base, min_quote, market_leverage, multiplier and open_positions
    (array of side, notional, sd, leverage, corr with the candidate), or in its place the positions' sums held_risk (of side times notional
    times sd times corr), held_notional and held_margin (of notional over leverage).  A size below the exchange's minimum is lifted to it
    only within the caps and with positive growth.
    """
    c, zero = F.col, F.lit(0.0)
    free = c("equity") - reserve
    total = lambda f: F.aggregate("open_positions", zero, lambda a, p: a + f(p))
    d = df.withColumn("__e", free).withColumn("__lcb", c("mu") - z * c("se")).withColumn("leverage", account_leverage(F.lit(gross_cap), c("market_leverage")))
    if "held_risk" in df.columns:
        risk, notional, margin = c("held_risk"), c("held_notional"), c("held_margin")
    else:
        risk, notional, margin = total(lambda p: p["side"] * p["notional"] * p["corr"] * p["sd"]), total(lambda p: p["notional"]), total(lambda p: p["notional"] / p["leverage"])
    d = d.withColumn("__cov", risk / c("__e") * c("sd") * c("side")).withColumn("__gross", notional / c("__e")).withColumn("__margin", margin / c("__e"))
    d = d.withColumn("__opt", F.when(c("sd") > 0, (c("__lcb") - c("__cov")) / (c("sd") * c("sd"))))
    caps = {
        "position": F.lit(position_cap), "gross": gross_cap - c("__gross"), "margin": (margin_cap - c("__margin")) * c("leverage"),
        "loss_budget": F.when(c("es") < 0, loss_share / F.abs("es")).otherwise(F.lit(float("inf"))), "validated_notional": max_notional / c("__e")}
    d = d.withColumns({f"__cap_{k}": v for k, v in caps.items()})
    d = d.withColumn("__cap", F.least(*[f"__cap_{k}" for k in caps]))
    binding = F.coalesce(*[F.when(c(f"__cap_{k}") == c("__cap"), F.lit(f"cap_{k}_exhausted")) for k in caps])
    refused = (
        F.when(c("__e") <= 0, "no_free_equity").when(c("multiplier") <= 0, "risk_halt").when(~F.coalesce(c("__lcb") > min_lcb, F.lit(False)), "ev_lcb_not_positive")
        .when(~F.coalesce((c("sd") > 0) & (c("price") > 0), F.lit(False)), "invalid_risk_estimate").when(c("__opt") <= 0, "portfolio_correlation").when(c("__cap") <= 0, binding))
    d = d.withColumn("__refused", refused).withColumn("__f", F.least(kappa * c("__opt") * c("multiplier"), c("__cap")))
    d = d.withColumn("__raw", quantize_down(c("__f") * c("__e") / c("price"), c("decimals")))
    feasible = (c("__raw") + 1e-12 >= c("min_base")) & (c("__raw") * c("price") + 1e-9 >= c("min_quote"))
    d = d.withColumn("__least", min_feasible_qty(c("min_base"), c("min_quote"), c("price"), c("decimals"))).withColumn("__fmin", c("__least") * c("price") / c("__e"))
    growth = c("__fmin") * c("__lcb") - 0.5 * c("__fmin") * c("__fmin") * c("sd") * c("sd") - c("__fmin") * c("__cov")
    lifted = (c("__fmin") <= c("__cap")) & (growth > 0)
    qty = F.when(c("__refused").isNotNull(), zero).when(feasible, c("__raw")).when(lifted, c("__least")).otherwise(zero)
    reason = F.coalesce("__refused", F.when(feasible, "ok").when(lifted, "raised_to_exchange_minimum").when(c("__fmin") > c("__cap"), "below_exchange_minimum_cap").otherwise("below_exchange_minimum_negative_growth"))
    d = d.withColumn("qty", qty).withColumn("size_reason", reason).withColumn("fraction", c("qty") * c("price") / c("__e"))
    return d.select(*df.columns, "leverage", "fraction", "qty", "size_reason")


def execution_choice(mu: Column, se: Column, p_fill: Column, mu_passive: Column, se_passive: Column, d_spread: Column, d_impact: Column, latency: Column, calibrated: Column, capacity: Column, z: float) -> Column:
    """aggressive, passive or why neither: the larger lower bound after the drift of costs."""
    drift = F.greatest(F.lit(0.0), d_spread / 2 + d_impact) / 1e4
    aggressive, passive = mu - drift - z * se, p_fill * (mu_passive - z * se_passive)
    return (
        F.when(capacity < 2, "transaction_capacity").when(latency > 2 * calibrated, "latency_degraded")
        .when(F.greatest(aggressive, passive) <= 0, "skip").when(passive > aggressive, "passive").otherwise("aggressive"))


def data_reason(lit_usable: Column, ref_usable: Column, lit_stale: Column, ref_stale: Column, clock: Column, stale_ms: float, clock_ms: float) -> Column:
    """First failing data check; what is missing fails."""
    within = lambda x, m: F.coalesce(x <= m, F.lit(False))
    return (
        F.when(~(lit_usable & ref_usable), "book_unusable").when(~within(lit_stale, stale_ms), "lit_stale").when(~within(ref_stale, stale_ms), "ref_stale")
        .when(F.abs(lit_stale - ref_stale) > 1500, "venue_skew").when(~within(clock, clock_ms), "clock_uncertain"))


def funding_adjusted(mu: Column, rate: Column, eta_s: Column, side: Column, horizon_s: Column, latency_ms: Column) -> Column:
    """The expectation less the funding that falls due inside the holding time (F09): longs pay a positive rate."""
    hold = horizon_s + F.coalesce(2 * latency_ms / 1000, F.lit(0.0))
    return mu - F.when(rate.isNotNull() & (eta_s >= 0) & (eta_s <= hold), rate * side).otherwise(0.0)


def cascade(df: DataFrame, *, z: float, min_lcb: float, stale_ms: float, clock_ms: float, **limits: float) -> DataFrame:
    """``df`` with step, ok, reason, exec_mode, qty, leverage, mu_adj, lcb: how far each signal gets in ten steps, and why no farther.

    1 eligibility (eligible, active, suspended); 2 synchronised data (usable, lit_stale, ref_stale, clock); 3 to 5 a side of the
    policy (side, mu, se, horizon_s); 6 funding (funding_rate, funding_eta_s, latency); 7 the lower bound; 8 no position open in
    the market (held: how many are, as of the signal); 9 the size as in ``allocate``; 10 execution (p_fill, mu_passive,
    se_passive, d_spread, d_impact, latency_cal, capacity).  One projection: what a signal needs of the past is in its row.
    """
    c = F.col
    adj = funding_adjusted(c("mu"), c("funding_rate"), c("funding_eta_s"), c("side"), c("horizon_s"), c("latency"))
    d = df.withColumn("mu_adj", adj).withColumn("lcb", c("mu_adj") - z * c("se")).withColumn("__mu", c("mu"))
    d = allocate(d.withColumn("mu", c("mu_adj")), z=z, min_lcb=min_lcb, **limits)
    funding = c("__mu") - c("mu_adj")
    choice = execution_choice(c("mu_adj"), c("se"), c("p_fill"), c("mu_passive") - funding, c("se_passive"), c("d_spread"), c("d_impact"), c("latency"), c("latency_cal"), c("capacity"), z)
    data = data_reason(c("usable"), c("usable"), c("lit_stale"), c("ref_stale"), c("clock"), stale_ms, clock_ms)
    sized = c("size_reason").isin("ok", "raised_to_exchange_minimum")
    d = d.withColumn("__data", data).withColumn("__choice", choice)
    failed = lambda step, reason: F.struct(F.lit(step).alias("step"), F.lit(False).alias("ok"), reason.alias("reason"))
    taken = c("__choice").isin("aggressive", "passive")
    result = (
        F.when(~(c("eligible") & c("active")), failed(1, F.lit("instrument_ineligible"))).when(c("suspended"), failed(1, F.lit("strategy_suspended")))
        .when(c("__data").isNotNull(), failed(2, c("__data"))).when(c("side") == 0, failed(3, F.lit("no_signal")))
        .when(~F.coalesce(c("lcb") > min_lcb, F.lit(False)), failed(7, F.lit("lcb_below_margin"))).when(c("held") > 0, failed(8, F.lit("position_open")))
        .when(~sized, failed(9, c("size_reason"))).when(~taken, failed(10, F.concat(F.lit("execution_"), c("__choice"))))
        .otherwise(F.struct(F.lit(10).alias("step"), F.lit(True).alias("ok"), c("size_reason").alias("reason"))))
    d = d.withColumn("__r", result)
    when_ok = lambda x: F.when(c("__r.ok"), x)
    signalled = c("__r.step") >= 7
    return d.select(
        *(c("__mu").alias("mu") if k == "mu" else c(k) for k in df.columns), "__r.*", when_ok(c("__choice")).alias("exec_mode"), when_ok(c("qty")).alias("qty"), when_ok(c("leverage")).alias("leverage"),
        F.when(signalled, c("mu_adj")).alias("mu_adj"), F.when(signalled, c("lcb")).alias("lcb"))


MULTIPLIERS = (1.0, 1e-3, 1e3, 1e-4, 1e4, 1e-6, 1e6)


def candidate_names(symbol: str, override: str) -> Column:
    """Reference symbols that a market may have, the likeliest first; an override replaces them."""
    s = F.col(symbol)
    stripped = [F.when(s.startswith(p) & (F.length(s) > len(p)), F.substring(s, len(p) + 1, 100)) for p in ("1000000", "1000", "K")]
    own = F.array_distinct(F.array_compact(F.array(s, F.concat(F.lit("1000"), s), F.concat(F.lit("1000000"), s), *stripped)))
    return F.when(F.col(override).isNotNull(), F.array(override)).otherwise(own)


def instrument_mapping(markets: DataFrame, prices: DataFrame, min_volume: float = 0.0, tolerance: float = 0.02) -> DataFrame:
    """For each market the first candidate and multiplier whose price fits, whether it is eligible, and a reason.

    ``markets``: symbol, last_price, active, volume, override (null: none), covered; ``prices``: candidate, price.  A candidate
    without a price is skipped.  Every market has a handful of candidates and seven multipliers, so the join
    is on the candidate.
    """
    # only what the price check needs travels to a candidate; a place is a number, so the least of them is kept in hash maps
    c = markets.select("symbol", "last_price", F.posexplode(candidate_names("symbol", "override")).alias("cand_pos", "candidate"))
    c = spread(c, "candidate").join(spread(prices.where("price > 0"), "candidate").hint("merge"), "candidate")
    fits = lambda x: (F.col("last_price") > 0) & (F.abs(F.col("last_price") / (F.col("price") * x) - 1) <= tolerance)
    first = F.coalesce(*[F.when(fits(F.lit(x)), F.lit(i)) for i, x in enumerate(MULTIPLIERS)])
    met = spread(c.select("symbol", (F.col("cand_pos") * len(MULTIPLIERS) + first).alias("place")), "symbol")
    met = met.groupBy("symbol").agg(F.min("place").alias("__place"), F.lit(True).alias("__seen"))
    name = candidate_names("symbol", "override")[F.floor(F.col("__place") / len(MULTIPLIERS)).cast("int")]
    times = F.array(*[F.lit(x) for x in MULTIPLIERS])[F.col("__place") % len(MULTIPLIERS)]
    out = spread(markets, "symbol").join(met.hint("merge"), "symbol", "left").withColumn("__best", F.when(F.col("__place").isNotNull(), F.struct(name.alias("candidate"), times.alias("multiplier"))))
    unmapped = F.when(F.col("__seen").isNull(), "not_covered").when(~F.coalesce(F.col("last_price") > 0, F.lit(False)), "no_price").otherwise("price_mismatch")
    reason = F.when(F.col("__best").isNull(), unmapped).when(~F.col("active"), "inactive").when(F.col("volume") < min_volume, "low_volume").when(~F.col("covered"), "outside_coverage").otherwise("ok")
    return out.select("symbol", F.col("__best.candidate").alias("candidate"), F.col("__best.multiplier").alias("multiplier"), (reason == "ok").alias("eligible"), reason.alias("reason"))


def eligible_symbols(mappings: DataFrame) -> DataFrame:
    """Symbols that the latest mapping (symbol, ts, eligible) of each calls eligible."""
    last = spread(mappings, "symbol").groupBy("symbol").agg(F.max_by("eligible", "ts").alias("eligible"))
    return last.where("eligible").select("symbol")
