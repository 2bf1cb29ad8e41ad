"""Signals, composite votes, sizing, friction backtest and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_day, next_bar
from .indicators import by_time

#: Thresholds (basis points) of the yield spread's change by regime; 15 for one that isn't known.
YIELD_THRESHOLDS = {0: 8.0, 1: 15.0, 2: 20.0}


def yield_momentum(days: DataFrame, yields: DataFrame) -> DataFrame:
    """Direction and strength from the latest spread change known at each day. days: (instrument, ts, regime)."""
    known = yields.select(F.col("date").alias("m_ts"), F.coalesce("spread_d5", "us_d5").alias("change")).where("change is not null")
    joined = asof_day(days, known, "ts", "m_ts", ["change"])
    limit = F.coalesce(F.create_map(*[x for k, v in YIELD_THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])[F.col("regime")], F.lit(15.0))
    strength = F.least(F.abs("change") / (limit * 2), F.lit(1.0))
    direction = F.when(F.col("change") > limit, "short").when(F.col("change") < -limit, "long").otherwise("flat")
    return joined.select("instrument", "ts", F.lit("yield_spread_momentum").alias("detector"), direction.alias("direction"), F.when(direction == "flat", 0.0).otherwise(strength).alias("strength"))


def forecast_signal(forecasts: DataFrame, floor: float = 0.05) -> DataFrame:
    """Direction of the median forecast p50 with strength |p50| / (|p50| + spread); flat under the floor or
    without a spread. forecasts: (instrument, ts, p50, spread)."""
    flat = (F.col("spread") <= 0) | (F.abs("p50") < floor) | F.col("p50").isNull()
    direction = F.when(flat, "flat").when(F.col("p50") > 0, "long").otherwise("short")
    strength = F.when(flat, 0.0).otherwise(F.least(F.abs("p50") / (F.abs("p50") + F.col("spread")), F.lit(1.0)))
    return forecasts.select("instrument", "ts", F.lit("forecast_directional").alias("detector"), direction.alias("direction"), strength.alias("strength"))


def confirmations(rows: DataFrame, direction: str = "direction") -> DataFrame:
    """Whether candle pattern, RSI and moving averages agree with a proposed direction; with h4_two (of
    ``indicators.with_h4``), also whether the last two four-hour bars do."""
    long, short = F.col(direction) == "long", F.col(direction) == "short"
    checks = {
        "candle": long & (F.col("engulfing_bull") | F.col("pin_bull")) | short & (F.col("engulfing_bear") | F.col("pin_bear")),
        "rsi": long & (F.col("rsi") < 30) | short & (F.col("rsi") > 70),
        "averages": long & (F.col("vs_ma50") > 0) & (F.col("vs_ma200") > 0) | short & (F.col("vs_ma50") < 0) & (F.col("vs_ma200") < 0),
    }
    if "h4_two" in rows.columns:
        checks["timeframes"] = long & (F.col("h4_two") == 2) | short & (F.col("h4_two") == -2)
    return rows.select("instrument", "ts", F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("confirmed")) for k, v in checks.items()])).alias("c")).select("instrument", "ts", "c.*")


def composite(votes: DataFrame, checks: DataFrame) -> DataFrame:
    """One decision a day: the side with the larger summed strength, its mean strength moved by +.05 for each
    confirmation and -.02 for each that fails; flat under .15 and on a tie."""
    score = lambda d: F.sum(F.when(F.col("direction") == d, F.col("strength")).otherwise(0.0))
    count = lambda d: F.count_if(F.col("direction") == d)
    tally = votes.groupBy("instrument", "ts").agg(score("long").alias("ls"), score("short").alias("ss"), count("long").alias("ln"), count("short").alias("sn"))
    moved = checks.groupBy("instrument", "ts").agg(F.sum(F.when(F.col("confirmed"), 0.05).otherwise(-0.02)).alias("adj"), F.count_if("confirmed").alias("tier2_count"))
    rows = tally.join(moved, ["instrument", "ts"], "left")
    side = F.when(F.col("ls") > F.col("ss"), "long").when(F.col("ss") > F.col("ls"), "short").otherwise("flat")
    base = F.when(side == "long", F.col("ls") / F.col("ln")).when(side == "short", F.col("ss") / F.col("sn"))
    strength = F.when(side == "flat", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.coalesce("adj", F.lit(0.0)))))
    weak = F.col("_s") < 0.15
    out = rows.withColumn("_side", side).withColumn("_s", strength)
    return out.select("instrument", "ts", F.when(weak, "flat").otherwise(F.col("_side")).alias("direction"), F.when(weak, 0.0).otherwise(F.round("_s", 4)).alias("strength"), (F.col("ln") + F.col("sn")).alias("signal_count"), F.coalesce("tier2_count", F.lit(0)).alias("tier2_count"))


def kelly_units(p: Column, balance: Column, regime: Column, *, reward: float = 1.5, fraction: float = 0.15, least: float = 0.55, leverage: float = 10.0) -> Column:
    """Units by fractional Kelly: none under the gate or in a crash, half in chop, at most 15 % of the balance."""
    full = (p * reward - (1 - p)) / reward
    share = F.least(full * fraction * F.when(regime == "high_vol_choppy", 0.5).otherwise(1.0), F.lit(0.15))
    return F.when((p < least) | (full <= 0) | (regime == "high_vol_crash"), 0).otherwise(F.round(balance * share * leverage)).cast("long")


def backtest(decisions: DataFrame, bars: DataFrame, *, equity: float = 100_000.0, multiplier: float = 50.0, tick: float = 0.25, ticks_per_side: float = 1.0) -> DataFrame:
    """Each decision (instrument, ts, direction, size) entered at the next bar's open and left at its close:
    points less a round trip, dollars, and the additive equity curve with its peak."""
    rows = next_bar(decisions, bars.select("instrument", "ts", "open", "high", "low", "close"), ["open", "high", "low", "close"]).where("next_ts is not null")
    move = F.col("close_next") - F.col("open_next")
    sign = F.when(F.col("direction") == "long", 1).when(F.col("direction") == "short", -1)
    net = F.coalesce(sign * move - 2 * ticks_per_side * tick, F.lit(0.0))
    so_far = by_time().rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.col("high_next") - F.col("open_next"), F.col("low_next") - F.col("open_next")
    rows = rows.withColumn("mfe", F.when(sign > 0, up).when(sign < 0, -down).otherwise(0.0)).withColumn("mae", F.when(sign > 0, down).when(sign < 0, -up).otherwise(0.0))
    rows = rows.withColumn("net_points", net).withColumn("pnl", F.col("size") * multiplier * F.col("net_points"))
    rows = rows.withColumn("equity", F.lit(equity) + F.sum("pnl").over(so_far))
    return rows.withColumn("peak", F.max("equity").over(so_far)).withColumn("turn", F.abs(F.col("size") - F.lag("size", 1, 0.0).over(by_time())))


def performance(curve: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """Per instrument: periods, yearly growth, Sharpe and Sortino of returns on equity, drawdown, growth over
    drawdown, exposure, turnover, win rate. An equity that ends at 0 or under has lost all."""
    before = F.col("equity") - F.col("pnl")
    rows = curve.withColumn("_r", F.when(before > 0, F.col("pnl") / before).otherwise(0.0))
    down = F.when(F.col("_r") < 0, F.col("_r"))
    year = F.sqrt(F.lit(252.0))
    ratio = lambda sd, ok: F.when(ok & (sd > 1e-12), F.avg("_r") / sd * year).otherwise(0.0)
    traded = (F.col("direction") != "flat") & (F.col("size") > 0)
    end = F.greatest(F.lit(initial) + F.sum("pnl"), F.lit(0.0))
    found = rows.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("periods"), (F.pow(end / initial, 252 / F.count(F.lit(1))) - 1).alias("cagr"),
        ratio(F.stddev_samp("_r"), F.count("_r") >= 2).alias("sharpe"),
        ratio(F.stddev_samp(down), F.count(down) >= 2).alias("sortino"),
        F.least(F.lit(0.0), F.min(F.when(F.col("peak") > 0, F.col("equity") / F.col("peak") - 1).otherwise(0.0))).alias("max_drawdown"),
        F.avg((F.col("size") > 0).cast("double")).alias("exposure"),
        F.sum("turn").alias("turnover"),
        F.coalesce(F.count_if(traded & (F.col("pnl") > 0)) / F.when(F.count_if(traded) > 0, F.count_if(traded)), F.lit(0.0)).alias("win_rate"),
    )
    return found.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0))


def sensitivity(swept: DataFrame, baseline: float = 1.0) -> DataFrame:
    """Relative change of a score for the relative change of a parameter, against the baseline of a one-at-a-time
    sweep; null without a score there. swept: (instrument, value, score)."""
    base = swept.where(F.col("value") == baseline).select("instrument", F.col("score").alias("_base"))
    rows = swept.where(F.col("value") != baseline).join(base, "instrument")
    return rows.select("instrument", "value", "score", ((F.col("score") / F.when(F.col("_base") != 0, F.col("_base")) - 1) / (F.col("value") / baseline - 1)).alias("sensitivity"))


def meta_labels(decisions: DataFrame, bars: DataFrame) -> DataFrame:
    """label: whether the direction would have gained from the next bar's open to its close; flat days left out."""
    rows = next_bar(decisions.where("direction != 'flat'"), bars.select("instrument", "ts", "open", "close"), ["open", "close"]).where("next_ts is not null")
    move = F.col("close_next") - F.col("open_next")
    return rows.withColumn("label", F.when(F.col("direction") == "long", move > 0).otherwise(move < 0).cast("int"))


def session_drawdown_halt(curve: DataFrame, limit: float = 0.02) -> DataFrame:
    """halted: the day's loss is more than the limit of the equity before it."""
    return curve.withColumn("halted", F.col("pnl") < -limit * (F.col("equity") - F.col("pnl")))


def feedback(trades: DataFrame, lookback: int = 20) -> DataFrame:
    """Per instrument and row: drift of confidence over win rate in the last rows before it, and the Kelly
    fraction and gates moved by it. trades: (instrument, ts, confidence, won)."""
    w = by_time().rowsBetween(-lookback, -1)
    drift = F.round(F.avg("confidence").over(w) - F.avg("won").over(w), 4)
    over = F.col("drift") - 0.05
    rows = trades.withColumn("drift", drift).where("drift is not null")
    moved = lambda base, k, most: F.when(over > 0, F.least(F.lit(most), F.round(base + k * over, 3))).otherwise(base)
    return rows.withColumns({
        "kelly": F.when(over > 0, F.greatest(F.lit(0.05), F.round(0.15 - 0.5 * over, 3))).otherwise(0.15),
        "gate_half": moved(0.55, 0.5, 0.65), "gate_full": moved(0.70, 0.5, 0.80),
    })
