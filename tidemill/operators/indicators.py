"""Technical indicators of bars (instrument, ts, open, high, low, close), one row for each bar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof


def by_time():
    return Window.partitionBy("instrument").orderBy("ts")


def before(column: str, k: int = 1) -> Column:
    return F.lag(column, k).over(by_time())


def with_ewms(rows: DataFrame, columns: dict[str, str], alpha: float, *, adjust: bool = False, least: int = 1, order: str = "ts", first: bool = True) -> DataFrame:
    """rows with the exponentially weighted mean of each column (name: column), as the recurrence up to the row
    (adjust: normalised weights; first False: the first value has no more weight than the others).

    Rows are numbered into blocks over which the weight falls to about 1e-8. Within a block the mean is a decayed
    prefix sum; the state at the end of the block before it, whose own past weighs 1e-8, is carried in twice, so
    the value is exact to a double. No row carries a list.
    """
    decay = 1 - alpha
    block = max(16, int(math.log(1e-8) / math.log(decay)))
    w = Window.partitionBy("instrument").orderBy(order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("instrument", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_n", F.row_number().over(w) - 1)
    out = out.withColumns({"_pos": F.col("_n") % block, "_block": F.floor(F.col("_n") / block)})
    power = lambda k: F.pow(F.lit(decay), k.cast("double"))
    share = F.lit(1.0) if adjust else F.when(F.col("_n") == 0, 1.0).otherwise(alpha) if first else F.lit(alpha)
    out = out.withColumns({f"_l_{n}": power(F.col("_pos")) * F.sum(share * F.col(c) * power(-F.col("_pos"))).over(inside) for n, c in columns.items()})
    ends = lambda value: F.when(F.col("_pos") == block - 1, value)
    out = out.withColumns({f"_a_{n}": F.coalesce(F.last(ends(F.col(f"_l_{n}")), ignorenulls=True).over(earlier), F.lit(0.0)) for n in columns})
    out = out.withColumns({f"_b_{n}": F.coalesce(F.last(ends(F.col(f"_l_{n}") + power(F.lit(block)) * F.col(f"_a_{n}")), ignorenulls=True).over(earlier), F.lit(0.0)) for n in columns})
    norm = (1 - power(F.col("_n") + 1)) / alpha if adjust else F.lit(1.0)
    total = {n: (F.col(f"_l_{n}") + power(F.col("_pos") + 1) * F.col(f"_b_{n}")) / norm for n in columns}
    out = out.withColumns({n: F.when(F.col("_n") >= least - 1, v) for n, v in total.items()})
    return out.drop("_n", "_pos", "_block", *[f"_{k}_{n}" for k in "lab" for n in columns])


def with_ewm(bars: DataFrame, column: str, out: str, alpha: float, adjust: bool = False, least: int = 1) -> DataFrame:
    return with_ewms(bars, {out: column}, alpha, adjust=adjust, least=least)


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """atr: exponential mean (span) of the true range; the first range is high - low."""
    close = before("close")
    ranged = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close), F.abs(F.col("low") - close)))
    return with_ewm(ranged, "tr", "atr", 2 / (period + 1))


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """rsi: from normalised exponential means of gains and losses (com = period - 1); 50 where undefined."""
    change = F.coalesce(F.col("close") - before("close"), F.lit(0.0))
    moved = bars.withColumn("_gain", F.greatest(change, F.lit(0.0))).withColumn("_loss", F.greatest(-change, F.lit(0.0)))
    both = with_ewms(moved, {"_up": "_gain", "_down": "_loss"}, 1 / period, adjust=True, least=period)
    value = 100 - 100 / (1 + F.col("_up") / F.when(F.col("_down") != 0, F.col("_down")))
    return both.withColumn("rsi", F.coalesce(value, F.lit(50.0))).drop("_gain", "_loss", "_up", "_down")


def sma(column: str, n: int) -> Column:
    frame = by_time().rowsBetween(-n + 1, 0)
    return F.when(F.count(column).over(frame) >= n, F.avg(column).over(frame))


def ema(bars: DataFrame, span: int, out: str = "ema") -> DataFrame:
    return with_ewm(bars, "close", out, 2 / (span + 1))


def body(bars: DataFrame) -> DataFrame:
    """body_dir (1, -1, 0), and the body's and both wicks' share of the range (0 if there is no range)."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    share = lambda x: F.when(h > l, x / (h - l)).otherwise(0.0)
    return bars.withColumns({
        "body_dir": F.signum(c - o).cast("int"),
        "body_pct": share(F.abs(c - o)),
        "upper_wick": share(h - F.greatest(o, c)),
        "lower_wick": share(F.least(o, c) - l),
    })


def patterns(bars: DataFrame) -> DataFrame:
    """Candle patterns of bars with body(): a larger body against the last one, a wick of more than 0.6 with
    a body under 0.25, a range inside the last one, a body under a tenth."""
    size, turn = F.abs(F.col("close") - F.col("open")), F.col("body_dir")
    w = by_time()
    was, larger = F.lag(turn).over(w), size > F.lag(size).over(w)
    ranged, small = F.col("high") > F.col("low"), F.col("body_pct") < 0.25
    found = {
        "engulfing_bull": (turn == 1) & (was == -1) & larger,
        "engulfing_bear": (turn == -1) & (was == 1) & larger,
        "pin_bull": ranged & (F.col("lower_wick") > 0.6) & small,
        "pin_bear": ranged & (F.col("upper_wick") > 0.6) & small,
        "inside_bar": (F.col("high") <= before("high")) & (F.col("low") >= before("low")),
        "doji": ranged & (F.col("body_pct") < 0.1),
    }
    return bars.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in found.items()})


def technical(bars: DataFrame) -> DataFrame:
    """The technical row of every bar: return, place against means, volatility, atr, rsi and body."""
    full = body(rsi(atr(bars)))
    full = full.withColumn("_r", F.col("close") / before("close") - 1)
    spread = lambda n: F.when(F.count("_r").over(by_time().rowsBetween(-n + 1, 0)) >= n, F.stddev_samp("_r").over(by_time().rowsBetween(-n + 1, 0)))
    return full.withColumns({
        "ret_pct": 100 * F.col("_r"),
        "vs_ma50": F.col("close") / sma("close", 50) - 1,
        "vs_ma200": F.col("close") / sma("close", 200) - 1,
        "vol5": spread(5),
        "vol20": spread(20),
    }).drop("_r")


H4_PART = ("h4_return_pct", "h4_body", "h4_trend6_pct", "h4_vol6", "h4_two")


def h4_technical(h4: DataFrame) -> DataFrame:
    """What is known at the END of each four-hour bar (instrument, bar_start, open, close): bar_end, the last
    return and the one over six bars in per cent, the deviation of the last six returns, the body's direction, and
    h4_two, the last two bars' directions added up (a bar that doesn't rise falls); null where bars are missing."""
    w = Window.partitionBy("instrument").orderBy("bar_start")
    six = w.rowsBetween(-5, 0)
    rows = h4.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1).withColumn("_d", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))
    two = F.when(F.lag("_d").over(w).isNotNull(), F.col("_d") + F.lag("_d").over(w))
    trend = F.when(F.count(F.lit(1)).over(six) >= 6, 100 * (F.col("close") / F.first("close").over(six) - 1))
    return rows.select(
        "instrument", (F.col("bar_start") + F.expr("INTERVAL 4 HOURS")).alias("bar_end"), (100 * F.col("_r")).alias("h4_return_pct"), F.when(F.col("_r").isNotNull(), F.signum(F.col("close") - F.col("open")).cast("int")).alias("h4_body"),
        trend.alias("h4_trend6_pct"), F.when(F.count("_r").over(six) >= 2, F.stddev_samp("_r").over(six)).alias("h4_vol6"), two.alias("h4_two"),
    )


def with_h4(days: DataFrame, h4: DataFrame, day: str = "session_date") -> DataFrame:
    """days with H4_PART of the last four-hour bar that had ended when the session did, at 17:00 in New York.
    Bars are local time, as ``bars.h4_bars`` gives them; a bar that runs on past the session's end isn't seen."""
    ends = days.withColumn("_end", F.col(day).cast("timestamp_ntz") + F.expr("INTERVAL 17 HOURS"))
    return asof(ends, h4_technical(h4), ["instrument"], "_end", "bar_end", list(H4_PART)).drop("_end", "asof")
