"""Deep pages by the index, and detector outputs against a plain loop."""

import math
import random

import pytest

from heliograph.operators import detector, pages


@pytest.mark.parametrize("offset,limit", [(0, 10), (95, 10), (437, 30), (985, 50), (1000, 5), (0, 2000)])
def test_pages_equal_a_sorted_list(spark, offset, limit):
    rng = random.Random(1)
    rows = [(i, rng.randrange(60), f"r{i}") for i in range(1000)]
    index = pages.build(spark.createDataFrame(rows, "id long, ts long, name string").repartition(7), "-ts", "-id", per_part=100)
    got = pages.page(index, offset, limit)
    want = sorted(rows, key=lambda r: (-r[1], -r[0]))[offset : offset + limit]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    parts = {f.rsplit("/", 2)[1] for f in got.inputFiles()} if want else set()
    assert len(parts) <= 2 + limit // 50 or limit == 2000


def test_an_empty_view_has_no_pages(spark):
    index = pages.build(spark.createDataFrame([], "id long, ts long"), "id")
    assert pages.page(index, 0, 10).count() == 0


def test_detector_outputs_decode_as_a_loop_does(spark):
    rng, side, rows, want = random.Random(5), 64, [], []
    for photo, (w, h) in enumerate([(640, 480), (30, 90), (64, 64), (1, 1000)]):
        scale = side / max(w, h)
        nw, nh = (min(max(math.floor(v * scale + 0.5), 1), side) for v in (w, h))
        px, py = (side - nw) // 2, (side - nh) // 2
        for stride in (8, 16, 32):
            wide = side // stride
            n = wide * wide
            cls, obj = ([rng.random() for _ in range(n)] for _ in range(2))
            bbox, kps = [rng.uniform(-1, 1) for _ in range(4 * n)], [rng.uniform(-2, 2) for _ in range(10 * n)]
            rows.append((photo, w, h, stride, cls, obj, bbox, kps))
            for i in range(n):
                if cls[i] * obj[i] >= 0.6:
                    r, c = divmod(i, wide)
                    x, y, bw, bh = (c + bbox[4 * i]) * stride, (r + bbox[4 * i + 1]) * stride, math.exp(bbox[4 * i + 2]) * stride, math.exp(bbox[4 * i + 3]) * stride
                    marks = [((c + kps[10 * i + 2 * k]) * stride, (r + kps[10 * i + 2 * k + 1]) * stride) for k in range(5)]
                    back = lambda p, q: ((p - px) / scale, (q - py) / scale)
                    (x1, y1), (x2, y2) = back(x - bw / 2, y - bh / 2), back(x + bw / 2, y + bh / 2)
                    want.append((photo, stride, i, cls[i] * obj[i], x1 / w, y1 / h, x2 / w, y2 / h, [v for m in marks for v in back(*m)]))
    a = "array<double>"
    rows.append((9, 10, 10, 8, [], [], [], []))
    df = spark.createDataFrame(rows, f"photo_id long, width long, height long, stride int, cls {a}, obj {a}, bbox {a}, kps {a}")
    got = sorted((*r[:8], [v for m in r["landmarks"] for v in m]) for r in detector.candidates(df, side).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, sorted(want)):
        assert g[3:8] == pytest.approx(w[3:8]) and g[8] == pytest.approx(w[8])
