"""Faces in pictures: work dealt out, areas from runs equal to a plain walk, rows of every PNG filter."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sparkveil.functions import images as I
from sparkveil.operators import pictures


def test_parts_of_one_row_group_are_dealt_out(spark, tmp_path):
    keys = list(range(20_001, 20_401))
    pq.write_table(pa.table({"p_partkey": keys}), tmp_path / "part.parquet")
    got = pictures.picture_faces(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.part for r in got} < set(keys) and len({r.part for r in got}) == len(got)
    assert all((r.x, r.y, r.w, r.h) == (6, 6, 12 + r.part % 8, 12 + r.part % 10) for r in got)


def test_areas_under_the_cap_are_not_walked(monkeypatch):
    image = np.full((60, 60, 4), 255, np.uint8)
    image[10:40, 10:36, :3] = (200, 150, 120)
    image[18:24, 14:30, :3] = 0
    walks, area = [], I._Field.area
    monkeypatch.setattr(I._Field, "area", lambda *a: walks.append(a) or area(*a))
    assert I.faces(image) == [(10, 10, 26, 30, 0.94)] and not walks
    monkeypatch.setattr(I, "FACE_CELLS", 500)  # of 684 cells
    I.faces(image)
    assert walks


def _walked(on, most):
    """Areas by a stack of cells, as the rule words them."""
    free, (height, width), out = on.copy(), on.shape, []
    for y in range(2, height - 2, max(2, height // 64)):
        for x in range(2, width - 2, max(2, width // 64)):
            if not free[y, x]:
                continue
            stack, seen, free[y, x] = [(y, x)], [], False
            while stack and len(seen) < most:
                j, i = stack.pop()
                seen.append((j, i))
                for b, a in ((j, i + 1), (j, i - 1), (j + 1, i), (j - 1, i)):
                    if 0 <= b < height and 0 <= a < width and free[b, a]:
                        free[b, a] = False
                        stack.append((b, a))
            rows, columns = zip(*seen, strict=True)
            out.append((min(columns), min(rows), max(columns) - min(columns) + 1, max(rows) - min(rows) + 1, len(seen)))
    return out, free


@pytest.mark.parametrize("most", [1, 40, 300, 15_000])
def test_areas_equal_a_walk(most):
    rng = np.random.default_rng(most)
    for share in (0.0, 0.3, 0.55, 0.65, 0.9, 1.0):
        for height, width in ((16, 40), (5, 4), (70, 33), (140, 131)):
            on = rng.random((height, width)) < share
            field = I._Field(height, width)
            field.free[1:-1, 1:-1] = on
            want, left = _walked(on, most)
            assert list(field.areas(most)) == want and (field.free[1:-1, 1:-1] == left).all()


def test_dark_share_at_the_limit_does_not_depend_on_place():
    """Red, green and blue times their weights, added in this order: a sum of 110 may come out just below."""
    for colour in ((200, 75, 54), (110, 110, 110), (124, 98, 136)):
        r, g, b = colour
        for n in range(1, 9):
            row = np.full((1, n, 4), (*colour, 255), np.uint8)
            assert (I._luminance(row) == 0.299 * r + 0.587 * g + 0.114 * b).all()


@pytest.mark.parametrize(("colour", "n"), [(0, 1), (4, 2), (2, 3), (6, 4)])
def test_rows_of_every_filter(colour, n):
    rng = np.random.default_rng(n)
    height, width = 12, 9
    pixels = rng.integers(0, 256, (height, width * n))
    kinds = [*range(5), *rng.permutation(5).tolist(), 4, 3]
    for start in (0, 3):  # the first row's filter, too
        raw, order = b"", kinds[start:] + kinds[:start]
        for y, kind in enumerate(order):
            line = []
            for x in range(width * n):
                left, up, corner = (pixels[y, x - n] if x >= n else 0), (pixels[y - 1, x] if y else 0), (pixels[y - 1, x - n] if y and x >= n else 0)
                near = min((left, up, corner), key=lambda v, t=left + up - corner: abs(t - v))
                line.append(int(pixels[y, x] - (0, left, up, (left + up) // 2, near)[kind]) % 256)
            raw += bytes([kind, *line])
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        got, want = I.decode_png(data), pixels.reshape(height, width, n)
        assert (got[..., :3] == (want[..., :3] if n >= 3 else want[..., :1])).all() and (got[..., 3] == (want[..., -1] if n in (2, 4) else 255)).all()
        got[0, 0] = 0  # the caller's own
