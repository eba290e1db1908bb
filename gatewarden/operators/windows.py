"""Exact sliding windows that stay cheap on one hot address. Rows are added up to seconds before an address's rows meet,
and every running sum has two levels: sums inside a range, and what was summed before the range begins, from the sums of
the ranges alone. Ranges of seconds hold SPAN seconds, ranges of positions ROWS rows, so an address with all rows of a
log is spread over as many tasks as it has ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UPTO = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)
#: Seconds, and rows, of a range in which running sums are taken.
SPAN, ROWS = 300, 50_000


def running(rows: DataFrame, at: str, values: dict[str, str], order: tuple, span: int = SPAN, upto: bool = True) -> DataFrame:
    """rows with running sums (new name -> column) of their address in an order that begins with `at`; the row itself
    counts if upto. Ranges are cut by `at`."""
    cut = rows.withColumn("_range", F.floor(F.col(at) / span))
    sums = cut.groupBy("ip", "_range").agg(*(F.sum(c).alias(n) for n, c in values.items()))
    earlier = Window.partitionBy("ip").orderBy("_range").rowsBetween(*BEFORE)
    opened = sums.select("ip", "_range", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("_0" + n) for n in values))
    inside = Window.partitionBy("ip", "_range").orderBy(*order).rowsBetween(*(UPTO if upto else BEFORE))
    out = cut.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in values.items()})
    return out.join(opened, ["ip", "_range"]).withColumns({n: F.col(n) + F.col("_0" + n) for n in values}).drop("_range", *("_0" + n for n in values))


def in_seconds(entries: DataFrame, *keep: str) -> DataFrame:
    """Narrow rows with their place in time order (stable) within their second: ip, sec, pos from 1 in each second,
    line, path, status, failed, and columns to keep."""
    from ..functions.text import seconds

    narrow = entries.select("ip", seconds(F.col("ts")).alias("sec"), "file_path", "line_number", "path", F.when(F.col("status").isin(401, 403), 1).otherwise(0).alias("failed"), *keep)
    return narrow.withColumn("pos", F.row_number().over(Window.partitionBy("ip", "sec").orderBy("file_path", "line_number")))


def positioned(entries: DataFrame, *keep: str) -> DataFrame:
    """in_seconds with pos from 1 over all rows of an address: rows before a second are known from the counts of seconds."""
    inside = in_seconds(entries, *keep)
    before = running(inside.groupBy("ip", "sec").agg(F.count("*").alias("n")), "sec", {"before": "n"}, ("sec",), upto=False).drop("n")
    return inside.join(before, ["ip", "sec"]).withColumn("pos", (F.col("before") + F.col("pos")).cast("int")).drop("before")


def totals_of_seconds(secs: DataFrame, windows: dict[str, int]) -> DataFrame:
    """second_totals, with n, of seconds that are added up already: ip, sec, n rows, f flagged ones. The end of each second's
    windows is looked up in one running sum over seconds and ends together."""
    ends = F.array(*(F.struct(F.lit(k).alias("window"), F.lit(v).cast("long").alias("w")) for k, v in windows.items()))
    own = F.array(F.struct(F.lit(None).cast("string").alias("window"), F.lit(0).cast("long").alias("w")))
    at = secs.withColumn("x", F.explode(F.concat(own, ends))).select("ip", "sec", "x.window", (F.col("sec") + F.col("x.w")).alias("t"), *(F.when(F.col("x.window").isNull(), F.col(c)).otherwise(0).alias(c) for c in ("n", "f")))
    # a second's own row comes before the ends at the same time, so that the window holds its last second
    both = running(at, "t", {"ce": "n", "fe": "f"}, ("t", F.col("window").asc_nulls_first()))
    pick = lambda c, k: F.max(F.when(F.col("window") == k, F.col(c)))
    start = lambda c, n: F.max(F.when(F.col("window").isNull(), F.col(c) - F.col(n)))
    wide = both.groupBy("ip", "sec").agg(start("ce", "n").alias("n0"), start("fe", "f").alias("f0"), F.max("n").alias("n"), *(F.struct(F.lit(k).alias("window"), pick("ce", k).alias("c"), pick("fe", k).alias("f")).alias(f"_{j}") for j, k in enumerate(windows)))
    found = wide.withColumn("x", F.explode(F.array(*(F.col(f"_{j}") for j in range(len(windows))))))
    return found.select("ip", "x.window", "sec", "n", (F.col("x.c") - F.col("n0")).alias("requests"), (F.col("x.f") - F.col("f0")).alias("flagged"))


def second_totals(rows: DataFrame, windows: dict[str, int], flag: str = "failed") -> DataFrame:
    """For every address, second with rows and window: rows and flagged rows in [sec, sec + W]."""
    return totals_of_seconds(rows.groupBy("ip", "sec").agg(F.count("*").alias("n"), F.sum(flag).alias("f")), windows).drop("n")


def window_peaks(rows: DataFrame, windows: dict[str, int], flag: str = "failed") -> DataFrame:
    """Per address and window the most rows and flagged rows; the first row of a second sees all of it."""
    return second_totals(rows, windows, flag).groupBy("ip", "window").agg(F.max("requests").alias("max_requests"), F.max("flagged").alias("max_flagged"))


def window_counts(rows: DataFrame, windows: dict[str, int], flag: str = "failed") -> DataFrame:
    """For every row and window [sec, sec + W], from that row on: requests and flagged rows."""
    inside = Window.partitionBy("ip", "sec").orderBy("pos").rowsBetween(*BEFORE)
    own = rows.select("ip", "sec", "pos", F.count(F.lit(1)).over(inside).alias("k"), F.coalesce(F.sum(flag).over(inside), F.lit(0)).alias("g"))
    return own.join(second_totals(rows, windows, flag), ["ip", "sec"]).select("ip", "window", "sec", "pos", (F.col("requests") - F.col("k")).alias("requests"), (F.col("flagged") - F.col("g")).alias("flagged"))


def islands(items: DataFrame, w: int, item: str, *last: str) -> DataFrame:
    """Spans of an address's item in which no gap is over w: first second, last second (with more of its columns).
    items: one row for each address, item and second."""
    per = Window.partitionBy("ip", item).orderBy("sec")
    cut = items.withColumn("new", (F.col("sec") - F.lag("sec").over(per) > w).cast("int"))
    cut = cut.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(per.rowsBetween(*UPTO)))
    return cut.groupBy("ip", item, "island").agg(F.min("sec").alias("first"), F.max(F.struct("sec", *last)).alias("last"))


def _islands(rows: DataFrame, w: int, item: str) -> DataFrame:
    return islands(rows.where(F.col(item).isNotNull()).groupBy("ip", item, "sec").agg(F.max("pos").alias("pos")), w, item, "pos")


def distinct_in_seconds(secs: DataFrame, spans: DataFrame, w: int) -> DataFrame:
    """For every address and second of secs: distinct items of [sec, sec + W] (n_distinct), and those of them whose last
    time in that window is the second itself (n_last). spans: islands."""
    up = spans.groupBy("ip", (F.col("first") - w).alias("t")).agg(F.count("*").alias("d")).select("ip", "t", F.lit(0).alias("kind"), "d", F.lit(0).cast("long").alias("e"))
    down = spans.groupBy("ip", F.col("last.sec").alias("t")).agg(F.count("*").alias("e")).select("ip", "t", F.lit(2).alias("kind"), (-F.col("e")).alias("d"), "e")
    asked = secs.select("ip", F.col("sec").alias("t")).select("ip", "t", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("e"))
    found = running(up.unionByName(asked).unionByName(down), "t", {"open": "d"}, ("t", "kind"))
    return found.groupBy("ip", F.col("t").alias("sec")).agg(F.max(F.when(F.col("kind") == 1, F.col("open"))).alias("n_distinct"), F.max("e").alias("n_last")).where("n_distinct IS NOT NULL")


def window_distinct(rows: DataFrame, w: int, item: str) -> DataFrame:
    """For every row: how many distinct items the window [sec, sec + W] holds from that row on. pos is the row's place
    among all rows of its address; an island of an item counts at the places from the first row of a window that reaches
    it to its last row, and the sums go over ranges of places, cut by the number of rows."""
    spans = _islands(rows, w, item)
    secs = rows.groupBy("ip", F.col("sec").alias("t")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(1))
    asked = spans.select("ip", (F.col("first") - w).alias("t")).distinct().withColumns({"n": F.lit(0).cast("long"), "kind": F.lit(0)})
    before = running(secs.unionByName(asked), "t", {"before": "n"}, ("t", "kind"), upto=False).where("kind = 0").select("ip", "t", "before")
    up = spans.withColumn("t", F.col("first") - w).join(before, ["ip", "t"]).select("ip", (F.col("before") + 1).alias("at"), F.lit(1).alias("d"))
    down = spans.select("ip", (F.col("last.pos") + 1).cast("long").alias("at"), F.lit(-1).alias("d"))
    steps = up.unionByName(down).groupBy("ip", "at").agg(F.sum("d").alias("d")).select("ip", "at", F.lit(0).alias("kind"), "d", F.lit(None).cast("long").alias("sec"))
    anchors = rows.select("ip", F.col("pos").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("d"), "sec")
    found = running(steps.unionByName(anchors), "at", {"n_distinct": "d"}, ("at", "kind"), span=ROWS)
    return found.where("kind = 1").select("ip", "sec", F.col("at").cast("int").alias("pos"), "n_distinct")


def window_items(anchors: DataFrame, rows: DataFrame, w: int, item: str) -> DataFrame:
    """For the given anchors (ip, sec, pos) of rows: the distinct items of their windows, sorted. For items of few kinds."""
    spans = _islands(rows, w, item).select("ip", F.col(item).alias("item"), (F.col("first") - w).alias("t0"), F.col("last.sec").alias("t1"), F.col("last.pos").alias("p1"))
    spans = spans.withColumn("span", F.explode(F.sequence(F.floor(F.col("t0") / SPAN), F.floor(F.col("t1") / SPAN))))
    met = anchors.select("ip", "sec", "pos").withColumn("span", F.floor(F.col("sec") / SPAN)).join(spans, ["ip", "span"])
    inside = (F.col("t0") <= F.col("sec")) & ((F.col("sec") < F.col("t1")) | (F.col("sec") == F.col("t1")) & (F.col("pos") <= F.col("p1")))
    return met.where(inside).groupBy("ip", "sec", "pos").agg(F.array_sort(F.collect_set("item")).alias("items"))
