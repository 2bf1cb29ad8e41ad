"""The order book at any time, from the lives of orders.

An order's messages by themselves tell when it rests, on which side, at which price and size: windows over
one order. A clearing ends all lives before it, so orders are told apart by how many clearings came before.
Every change of an order is a change of a level's size; a level's size at a time is a running sum of its
changes. No task replays an instrument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["ts", "seq"]
SIDES = ("A", "B")


def running_count(rows: DataFrame, flag: Column, name: str, grain: str = "minute") -> DataFrame:
    """rows with the number of flagged rows of their instrument up to and with them, in two levels: totals of
    spans of time first, then rows within a span, so that no task sorts an instrument."""
    spans = rows.withColumn("_span", F.date_trunc(grain, "ts"))
    totals = spans.groupBy("instrument", "_span").agg(F.count_if(flag).alias("_here"))
    past = Window.partitionBy("instrument").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("instrument", "_span", F.coalesce(F.sum("_here").over(past), F.lit(0)).alias("_before"))
    within = Window.partitionBy("instrument", "_span").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    counted = spans.withColumn("_in", F.sum(F.when(flag, 1).otherwise(0)).over(within))
    return counted.join(totals, ["instrument", "_span"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_span", "_before", "_in")


def order_lives(records: DataFrame) -> DataFrame:
    """(instrument, life, order_id, ts, seq, side, price, size): what each message leaves of its order; side is
    null where the order is gone. life counts the clearings before.

    records: (instrument, ts, seq, action, side, order_id, price, size). A and M place an order where they tell
    its side; M without a side changes one that rests; F takes off what was filled; C removes; R clears all;
    other actions change nothing.
    """
    rows = records.select("instrument", "ts", "seq", "action", "side", "order_id", "price", "size").where("action in ('A', 'C', 'M', 'F', 'R')")
    rows = running_count(rows, F.col("action") == "R", "life").where("action != 'R'")
    order = Window.partitionBy("instrument", "life", "order_id").orderBy(*ORDER)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sided = F.coalesce(F.col("side").isin(*SIDES), F.lit(False))
    place = F.col("action").isin("A", "M") & sided
    change = (F.col("action") == "M") & ~sided
    rows = rows.where(place | change | F.col("action").isin("C", "F"))
    rows = rows.withColumn("_stay", F.count_if(place | (F.col("action") == "C")).over(so_far)).withColumn("_step", F.count_if(place | change | (F.col("action") == "C")).over(so_far))
    stay = Window.partitionBy("instrument", "life", "order_id", "_stay").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    step = Window.partitionBy("instrument", "life", "order_id", "_step").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.sum(F.when(F.col("action") == "F", F.col("size"))).over(step), F.lit(0))
    rows = rows.withColumn("_left", F.first("size").over(step) - filled).withColumn("_price", F.first("price").over(step))
    gone = F.max((F.col("action") == "F") & (F.col("_left") <= 0)).over(stay)
    placed = F.first(F.when(place, F.col("side"))).over(stay)  # null for a stay that a removal began, or nothing
    rows = rows.withColumn("_side", F.when(~gone, placed))
    return rows.select("instrument", "life", "order_id", "ts", "seq", F.col("_side").alias("side"), F.when(F.col("_side").isNotNull(), F.col("_price")).alias("price"), F.when(F.col("_side").isNotNull(), F.col("_left")).alias("size"))


def level_changes(records: DataFrame) -> DataFrame:
    """(instrument, life, ts, seq, side, price, size, orders): by how much each message changes a level."""
    lives = order_lives(records)
    order = Window.partitionBy("instrument", "life", "order_id").orderBy(*ORDER)
    old = F.lag(F.struct("side", "price", "size")).over(order)
    two = lives.withColumn("_old", old).select("instrument", "life", "ts", "seq", F.explode(F.array(F.struct("side", "price", "size", F.lit(1).alias("orders")), F.struct("_old.side", "_old.price", (-F.col("_old.size")).alias("size"), F.lit(-1).alias("orders")))).alias("c"))
    return two.where("c.side is not null").select("instrument", "life", "ts", "seq", "c.*")


def levels_at(records: DataFrame, times: DataFrame, depth: int = 10) -> DataFrame:
    """The best levels of each side at times (instrument, ts, seq), after all messages up to them: (instrument,
    ts, seq, side, price, size, orders, level). A level stands in as many rows as there are times in its life;
    a time at which nothing rests has none."""
    return levels_of(level_changes(records), records.where("action = 'R'").select("instrument", "ts", "seq"), times, depth)


def levels_of(changes: DataFrame, cleared: DataFrame, times: DataFrame, depth: int = 10) -> DataFrame:
    """levels_at from the changes of levels and the clearings (instrument, ts, seq). Changes of one level at one
    time and sequence may be given as their sum."""
    ticks = times.select("instrument", "ts", "seq", F.lit(True).alias("_asked"))
    # Times get their life and their number; a change belongs to the first time at or after it. At one time and
    # sequence messages come before the time.
    turn = (F.col("seq") * 2 + F.col("_asked").cast("int")).alias("seq")
    asked = running_count(ticks.unionByName(cleared.withColumn("_asked", F.lit(False))).withColumn("seq", turn), ~F.col("_asked"), "life").where("_asked")
    both = changes.withColumn("_asked", F.lit(False)).withColumn("seq", turn).unionByName(asked, allowMissingColumns=True)
    number = running_count(both, F.col("_asked"), "n")
    slot = F.when(F.col("_asked"), F.col("n")).otherwise(F.col("n") + 1)
    placed = number.withColumn("slot", slot).withColumn("seq", F.floor(F.col("seq") / 2))
    asked = placed.where("_asked").select("instrument", "life", "slot", "ts", "seq")
    last = asked.groupBy("instrument", "life").agg(F.max("slot").alias("_last"))
    level = ["instrument", "life", "side", "price"]
    sums = placed.where("not _asked").groupBy(*level, "slot").agg(F.sum("size").alias("_size"), F.sum("orders").alias("_orders"))
    w = Window.partitionBy(*level).orderBy("slot")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    known = sums.select(*level, "slot", F.sum("_size").over(up_to).alias("size"), F.sum("_orders").over(up_to).alias("orders"), F.lead("slot").over(w).alias("_next"))
    known = known.where("orders > 0").join(last, ["instrument", "life"])
    until = F.least(F.coalesce(F.col("_next") - 1, F.col("_last")), F.col("_last"))
    rests = known.withColumn("_until", until).where("slot <= _until").select(*level, "size", "orders", F.explode(F.sequence("slot", "_until")).alias("slot"))
    found = rests.join(asked, ["instrument", "life", "slot"])
    best = Window.partitionBy("instrument", "ts", "seq", "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")))
    return found.withColumn("level", F.row_number().over(best)).where(F.col("level") <= depth).select("instrument", "ts", "seq", "side", "price", "size", "orders", "level")


def book_at(records: DataFrame, times: DataFrame, depth: int = 10) -> DataFrame:
    """The book at times (instrument, ts, seq): (instrument, ts, seq, bid_px, ask_px, bid_sz, ask_sz,
    imbalance_l1, imbalance_depth); best prices and sizes and the imbalance of the best level and of the best
    depth levels, null where a side is empty."""
    return _book(levels_at(records, times, depth), times)


def book_of(changes: DataFrame, times: DataFrame, depth: int = 10) -> DataFrame:
    """book_at from the changes of levels of a book that is never cleared."""
    return _book(levels_of(changes, times.select("instrument", "ts", "seq").limit(0), times, depth), times)


def _book(levels: DataFrame, times: DataFrame) -> DataFrame:
    at = lambda side, c: F.max(F.when((F.col("side") == side) & (F.col("level") == 1), F.col(c)))
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("size")))
    keys = ["instrument", "ts", "seq"]
    found = levels.groupBy(*keys).agg(at("B", "price").alias("bid_px"), at("A", "price").alias("ask_px"), at("B", "size").alias("bid_sz"), at("A", "size").alias("ask_sz"), total("B").alias("_b"), total("A").alias("_a"))
    share = lambda b, a: F.when(F.col(b) + F.col(a) != 0, (F.col(b) - F.col(a)) / (F.col(b) + F.col(a)))
    found = found.select(*keys, "bid_px", "ask_px", "bid_sz", "ask_sz", share("bid_sz", "ask_sz").alias("imbalance_l1"), share("_b", "_a").alias("imbalance_depth"))
    return times.select(*keys).join(found, keys, "left")
