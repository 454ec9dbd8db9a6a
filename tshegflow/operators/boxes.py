"""Boxes of text lines on scanned pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WIDTH, LEAST_HEIGHT = 0.01, 10
LINE_THRESHOLD = 20


def large_enough(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes that are wider than a hundredth of their page and higher than ten pixels; page widths are points, boxes pixels."""
    wide = pages.select("page_id", F.col("width").alias("page_width"))
    return boxes.join(wide, "page_id").where((F.col("width") > LEAST_WIDTH * F.col("page_width") * 300 / 72) & (F.col("height") > LEAST_HEIGHT)).drop("page_width")


def rotation(angles: DataFrame, most: float = 5.0) -> DataFrame:
    """``(page_id, angle)``: the mean of the small angles if they are the majority, else what the mean of the large ones lacks to a right angle, else 0."""
    a = F.col("angle")
    low, high = (F.abs(a) != 0) & (a < most), (F.abs(a) != 90) & (a > 90 - most)
    sums = angles.groupBy("page_id").agg(F.count_if(low).alias("lows"), F.count_if(high).alias("highs"), F.avg(F.when(low, a)).alias("low"), F.avg(F.when(high, a)).alias("high"))
    angle = F.when((F.col("lows") > F.col("highs")) & (F.col("lows") > 0), F.col("low")).when(F.col("highs") > 0, F.col("high") - 90).otherwise(F.lit(0.0))
    return sums.select("page_id", F.round(angle, 6).alias("angle"))


def centers(boxes: DataFrame) -> DataFrame:
    """``boxes`` (``page_id``, ``line_id``, ``x``, ``y``, ``width``, ``height``) with ``x_center`` and ``y_center``, whole numbers, halves rounded down. Repeated boxes come out once."""
    once = boxes.select("page_id", "line_id", "x", "y", "width", "height").distinct()
    half = lambda at, size: (F.col(at) + F.floor(F.col(size) / 2)).cast("int").alias(f"{at}_center")
    return once.select("*", half("x", "width"), half("y", "height"))


def merged(boxes: DataFrame, groups: DataFrame) -> DataFrame:
    """``(page_id, line_no, x, y, width, height)``: the box around all boxes of each line.

    ``boxes`` are ``centers``; ``groups`` names the centres of each line, as ``line_groups`` does. A centre stands for the first box that has it, by ``line_id``.
    """
    first = boxes.groupBy("page_id", F.col("x_center").alias("cx"), F.col("y_center").alias("cy")).agg(F.min_by(F.struct("x", "y", "width", "height"), "line_id").alias("b"))
    met = groups.select("page_id", "line_no", F.col("x").alias("cx"), F.col("y").alias("cy")).join(first, ["page_id", "cx", "cy"])
    left, top = F.min("b.x"), F.min("b.y")
    around = (left.alias("x"), top.alias("y"), (F.max(F.col("b.x") + F.col("b.width")) - left).alias("width"), (F.max(F.col("b.y") + F.col("b.height")) - top).alias("height"))
    return met.groupBy("page_id", "line_no").agg(*around)


def line_threshold(boxes: DataFrame, slice_width: int = 20) -> DataFrame:
    """``(page_id, slice_start, boxes, threshold)``: of the vertical slices across a page's boxes, the one that meets most of them, the leftmost of several; the threshold
    is the median height of their centres over their number, rounded down.

    Slices start at every multiple of half as many steps as slices fit, as far as they fit; a page too narrow for two slices has a row with threshold 0.
    """
    once = boxes.select("page_id", "line_id", "x", "y", "width", "height").distinct()
    frame = once.groupBy("page_id").agg(F.min("x").alias("left"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("wide"))
    step = F.floor(F.floor(F.col("wide") / slice_width) / 2).cast("int")
    starts = frame.select("page_id", F.explode_outer(F.when(step >= 1, F.transform(F.sequence(F.lit(1), step), lambda i: (F.col("left") + step * i).cast("int")))).alias("slice_start"))
    met = starts.join(once, "page_id").where((F.col("x") < F.col("slice_start") + slice_width) & (F.col("x") + F.col("width") > F.col("slice_start")))
    each = met.groupBy("page_id", "slice_start").agg(F.count(F.lit(1)).alias("boxes"), F.median(F.col("y") + F.floor(F.col("height") / 2)).alias("middle"))
    best = each.groupBy("page_id").agg(F.max_by(F.struct("slice_start", "boxes", "middle"), F.struct("boxes", -F.col("slice_start"))).alias("s"))
    return frame.select("page_id").join(best, "page_id", "left").select("page_id", "s.slice_start", F.coalesce("s.boxes", F.lit(0)).alias("boxes"), F.coalesce(F.floor(F.col("s.middle") / F.col("s.boxes")), F.lit(0)).cast("double").alias("threshold"))


def curved_share(flags: DataFrame) -> DataFrame:
    """``(page_id, lines, share)``: the share of each page's lines that are curved. ``flags`` has ``page_id`` and ``curved``; nulls count as straight."""
    return flags.groupBy("page_id").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg(F.coalesce("curved", F.lit(False)).cast("int")), 6).alias("share"))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(page_id, place, left, right)``: two ordered lists of each page joined by position, as far as both go. Both have ``page_id`` and ``items``."""
    both = left.select("page_id", F.col("items").alias("l")).join(right.select("page_id", F.col("items").alias("r")), "page_id")
    n = F.least(F.size("l"), F.size("r"))
    return both.select("page_id", F.posexplode(F.arrays_zip(F.slice("l", F.lit(1), n).alias("left"), F.slice("r", F.lit(1), n).alias("right"))).alias("at", "z")).select("page_id", (F.col("at") + 1).alias("place"), "z.left", "z.right")


def line_groups(centers: DataFrame, threshold: float = LINE_THRESHOLD) -> DataFrame:
    """``(page_id, line_no, place, x, y)``: centres of boxes gathered into lines, last line first, left to right.

    ``centers`` has ``page_id``, ``box_no``, ``x``, ``y``. In the order of ``box_no``, a centre joins the line at hand if it is within ``threshold`` of the mean height of
    that line so far. A page's boxes are handled together.
    """

    def gather(boxes: list[dict]) -> list[dict]:
        lines: list[list[tuple[int, int]]] = []
        height = 0.0
        for box in boxes:
            x, y = box["x"], box["y"]
            if lines and abs(height / len(lines[-1]) - y) <= threshold:
                lines[-1].append((x, y))
                height += y
            else:
                lines.append([(x, y)])
                height = float(y)
        return [{"line_no": n, "place": k, "x": x, "y": y} for n, line in enumerate(reversed(lines), 1) for k, (x, y) in enumerate(sorted(line, key=lambda c: c[0]), 1)]

    @F.pandas_udf("array<struct<line_no: int, place: int, x: int, y: int>>")
    def grouped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([gather(boxes) for boxes in pages])

    base = centers.select(F.col("page_id").cast("long").alias("page_id"), F.col("box_no").cast("long").alias("box_no"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).where("page_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    pages = base.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("box_no", "x", "y"))).alias("boxes"))
    return pages.select("page_id", F.inline(grouped.asNondeterministic()("boxes")))
