"""The overlap filter of crowded pages against the plain one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from querent.operators import geometry


def plain(boxes, share=geometry.OVERLAP):
    area = lambda b: max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    out = []
    for _, _, b in sorted((-area(b), i, b) for i, b in enumerate(boxes)):
        inter = lambda k: max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1]))  # noqa: B023, E731
        if not (area(b) and any(inter(k) / area(b) >= share for k in out)):
            out.append(b)
    return out


def page(n, seed, width=2000):
    rng = random.Random(seed)
    boxes = []
    for _ in range(n):
        x, y = rng.randrange(-50, width), rng.randrange(-50, width)
        w, h = rng.choice([(30, 12), (31, 11), (400, 8), (7, 300), (600, 500), (0, 9), (-4, 6), (64, 64)])
        boxes.append([x, y, x + w + rng.randrange(3), y + h])
        if rng.random() < 0.3:
            boxes.append(list(boxes[-1]))
    return boxes


@pytest.mark.parametrize("share", [0.6, 0.51, 0.5, 0.3, 0.95])
def test_kept_boxes_equal_the_plain_filter(share):
    for seed in range(6):
        boxes = page(300, seed, 100 + 200 * seed)
        assert geometry.kept_boxes(boxes, share) == plain(boxes, share)


def test_a_page_of_many_boxes():
    boxes = page(16_000, 9, 4000)
    assert len(boxes) > 20_000
    began = time.time()
    got = geometry.kept_boxes(boxes)
    took = time.time() - began
    small = [b for b in boxes if b[0] < 400 and b[1] < 400]
    assert geometry.kept_boxes(small) == plain(small)
    began = time.time()
    geometry.kept_boxes(page(64_000, 9, 8000))
    assert time.time() - began < 8 * took + 2  # four times the boxes at the same density
    assert 0 < len(got) < len(boxes)


def test_crowded_pages_in_spark(spark):
    rows = [(1, page(200, 1, 300)), (2, []), (3, None), (4, page(1, 2)), (5, [[0, 0, 9, 9]] * 5)]
    df = spark.createDataFrame(rows, "id int, boxes array<array<int>>")
    got = df.select("id", geometry.filter_crowded()("boxes").alias("a"), geometry.filter_boxes(F.col("boxes")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and len(got) == 5
