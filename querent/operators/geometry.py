"""Boxes: areas, overlaps, the greedy overlap filter, and tile grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP = 0.6
CONFIDENCE = 0.1


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b[2] - b[0]) * F.greatest(F.lit(0), b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def inside(small: Column, large: Column, share: float) -> Column:
    """Whether at least `share` of the small box lies in the large one; a box without area never does."""
    own = area(small)
    return (own > 0) & (intersection(small, large) / F.when(own > 0, own) >= share)


def filter_boxes(boxes: Column, share: float = OVERLAP) -> Column:
    """The boxes (array of [x1, y1, x2, y2]) left when, from the largest down, each kept box removes those that lie in it.

    Removed boxes remove nothing. Ties in area go by position. A fold over the sorted array: a box stays unless a
    kept one covers it.
    """
    ordered = F.array_sort(F.transform(boxes, lambda b, i: F.struct((-area(b)).alias("a"), i.alias("i"), b.alias("b"))))
    none = F.array().cast("array<struct<a:int,i:int,b:array<int>>>")
    kept = F.aggregate(ordered, none, lambda acc, x: F.when(F.exists(acc, lambda k: F.coalesce(inside(x["b"], k["b"], share), F.lit(False))), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda k: k["b"])


def filter_crowded(share: float = OVERLAP):
    """A function of a column as filter_boxes(), for pages of many thousand boxes; it runs in Arrow batches.

    See kept_boxes(): the work grows with the number of boxes, not with its square.
    """

    @F.pandas_udf("array<array<int>>")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if boxes is None else kept_boxes([list(map(int, b)) for b in boxes], share) for boxes in pages], dtype=object)

    return run


def kept_boxes(boxes: list[list[int]], share: float = OVERLAP) -> list[list[int]]:
    """The boxes that filter_boxes() keeps, from the largest down, with a grid over the page for each size of box.

    A box that covers more than half of another holds its middle. So kept boxes are entered, by the powers of two of their
    width and height, into the cells of a grid of that size, which are four at most; a box is only held against those in
    the cells that its middle lies in, one of each size. In a cell of one size few boxes find room that don't cover
    each other. Shares up to a half say nothing of the middle: then every kept box is looked at.
    """
    size = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    grids: dict[tuple[int, int], dict[tuple[int, int], list[list[int]]]] = {}
    out: list[list[int]] = []

    def covers(k: list[int], b: list[int], own: int) -> bool:
        return max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1])) / own >= share

    def near(b: list[int]):
        if share <= 0.5:
            yield out
            return
        x, y = (b[0] + b[2]) // 2, (b[1] + b[3]) // 2
        for (w, h), cells in grids.items():
            yield cells.get((x >> w, y >> h), ())

    for _, _, b in sorted((-size(b), i, b) for i, b in enumerate(boxes)):
        own = size(b)
        if own and any(covers(k, b, own) for some in near(b) for k in some):
            continue
        out.append(b)
        if own:
            w, h = (b[2] - b[0]).bit_length(), (b[3] - b[1]).bit_length()
            cells = grids.setdefault((w, h), {})
            for x in range(b[0] >> w, (b[2] >> w) + 1):
                for y in range(b[1] >> h, (b[3] >> h) + 1):
                    cells.setdefault((x, y), []).append(b)
    return out


def tile_grid(images: DataFrame, most: int = 12, tile: int = 448) -> DataFrame:
    """images (width, height) with columns and rows of the grid of at most `most` tiles whose shape is nearest to theirs.

    Of grids equally near, a later one (by tiles, then columns) wins if the image has more than half its area.
    """
    grids = sorted({(c, r) for c in range(1, most + 1) for r in range(1, most + 1) if c * r <= most}, key=lambda g: (g[0] * g[1], g[0]))
    options = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(r).alias("r")) for c, r in grids))
    shape = F.col("width") / F.col("height")
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(1).alias("c"), F.lit(1).alias("r"))

    def step(acc: Column, g: Column) -> Column:
        d = F.abs(shape - g["c"] / g["r"])
        roomy = F.col("width") * F.col("height") > 0.5 * tile * tile * g["c"] * g["r"]
        new = F.struct(d.alias("d"), g["c"].alias("c"), g["r"].alias("r"))
        return F.when(d < acc["d"], new).when((d == acc["d"]) & roomy, new).otherwise(acc)

    best = F.aggregate(options, start, step)
    return images.withColumn("_b", best).select("*", F.col("_b.c").alias("tile_columns"), F.col("_b.r").alias("tile_rows")).drop("_b")
