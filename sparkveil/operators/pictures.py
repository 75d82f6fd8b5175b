"""Image kernels over tables: pictures derived from part numbers are encoded, redacted, shrunk and read back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import images as I
from ..sources import table

SIDE, BOX = 12, (2, 2, 8, 8)


@F.pandas_udf(T.BinaryType())
def painted(a: pd.Series, b: pd.Series) -> pd.Series:
    """A grey PNG whose pixels follow from two numbers."""
    y, x = np.mgrid[:SIDE, :SIDE]

    def one(p: int, q: int) -> bytes:
        grey = ((x * p * 9 + y * q * 5 + p * q) % 256).astype(np.uint8)
        return I.encode_png(np.dstack([grey, grey, grey, np.full_like(grey, 255)]))

    return pd.Series([one(int(p), int(q)) for p, q in zip(a, b, strict=True)])


@F.pandas_udf(T.LongType())
def weighed(images: pd.Series) -> pd.Series:
    """Sum of a picture's red values, each times its place in reading order, from one."""
    return images.map(lambda data: int((I.decode_png(data)[..., 0].astype(np.int64).ravel() * np.arange(1, SIDE * SIDE + 1)).sum()))


def shrunk(longest: int):
    """Arrow function: a picture with its longer side at most ``longest``."""

    @F.pandas_udf(T.BinaryType())
    def run(images: pd.Series) -> pd.Series:
        return images.map(lambda data: I.encode_png(I.resize(I.decode_png(data), longest)))

    return run


@F.pandas_udf(T.ArrayType(T.LongType()))
def sizes(images: pd.Series) -> pd.Series:
    """[height, width, first red value] of pictures."""
    return images.map(lambda data: [*(p := I.decode_png(data)).shape[:2], int(p[0, 0, 0])])


def image_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighed pixels of each picture with a box covered by every style (I1 to I4), and its size when shrunk to 7 pixels."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("part"), painted((F.col("p_partkey") % 7 + 1).cast("int"), (F.col("p_partkey") % 5 + 1).cast("int")).alias("image"))
    box = F.array(F.struct(*[F.lit(v).alias(c) for c, v in zip("xywh", BOX, strict=True)]))
    covered = lambda style: weighed(I.redact_images(style)(F.col("image"), box)).alias(style)
    small: Column = sizes(shrunk(7)(F.col("image")))
    target = G.target_size(F.lit(SIDE), F.lit(SIDE), 7)
    return rows.select("part", weighed("image").alias("plain"), covered("solid"), covered("pixelate"), covered("blur"), F.get(small, 0).alias("height"), F.get(small, 2).alias("corner"), target["w"].alias("width"))


#: A page of two words on one line, and a picture of a face, both of sides that follow from a part's number.
PAGE, FACE = (40, 60), 64
_LINES = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in "xywh"]))
_FACES = T.ArrayType(T.StructType([*[T.StructField(c, T.LongType()) for c in "xywh"], T.StructField("confidence", T.DoubleType())]))


@F.pandas_udf(T.BinaryType())
def written(parts: pd.Series) -> pd.Series:
    """A page with two words; height, widths, gap, ground and contrast follow from the number."""

    def one(p: int) -> bytes:
        ground, ink = (20, 20 + 15 * (p % 4)) if p % 2 else (250, 250 - 15 * (p % 4))
        page = np.full((*PAGE, 4), ground, np.uint8)
        page[..., 3] = 255
        low, first, gap, second = 4 + 2 + p % 3, 3 + p % 5, 6 + p % 7, 4 + p % 6
        page[4:low, 3 : 3 + first, :3] = page[4:low, 3 + first + gap : 3 + first + gap + second, :3] = ink
        return I.encode_png(page)

    return pd.Series([one(int(p)) for p in parts])


@F.pandas_udf(T.BinaryType())
def portrait(parts: pd.Series) -> pd.Series:
    """A skin-coloured rectangle with a dark one inside on white."""

    def one(p: int) -> bytes:
        image = np.full((FACE, FACE, 4), 255, np.uint8)
        image[6 : 6 + 12 + p % 10, 6 : 6 + 12 + p % 8, :3] = (200, 150, 120)
        image[8 : 8 + 1 + p % 9, 8 : 8 + 1 + p % 7, :3] = 0
        return I.encode_png(image, 1)  # read back at once: quick rather than small

    return pd.Series([one(int(p)) for p in parts])


@F.pandas_udf(_LINES)
def lines_of(images: pd.Series) -> pd.Series:
    return images.map(lambda data: [dict(zip("xywh", b, strict=True)) for b in I.text_lines(I.decode_png(data))])


@F.pandas_udf(_FACES)
def faces_of(images: pd.Series) -> pd.Series:
    return images.map(lambda data: [dict(zip(("x", "y", "w", "h", "confidence"), f, strict=True)) for f in I.faces(I.decode_png(data))])


def picture_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of text found in a picture for each part."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("part"))
    return rows.select("part", F.posexplode(lines_of(written("part"))).alias("ord", "b")).select("part", F.col("ord").cast("long").alias("ord"), "b.*")


def picture_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces found in a picture for each part.

    Part numbers are few bytes and pictures much work: they are dealt out first, else a row group of a million goes to one task.
    """
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("part"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("part", F.explode(faces_of(portrait("part"))).alias("f")).select("part", "f.*")


QUERIES = {"image_redaction": image_redaction, "picture_text_lines": picture_text_lines, "picture_faces": picture_faces}
_BLUR = lambda src, axis, other: f"(SELECT i.part, i.x, i.y, (2 * sum(n.v) + 17) // 34 AS v FROM {src} i JOIN range(-8, 9) g(d) ON true JOIN {src} n ON n.part = i.part AND n.{other} = i.{other} AND n.{axis} = greatest(2, least(9, i.{axis} + d)) GROUP BY i.part, i.x, i.y)"
ORACLE = {
    "picture_text_lines": f"""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS part, 2 + p_partkey % 3 AS h, 3 + p_partkey % 5 AS a, 6 + p_partkey % 7 AS gap, 4 + p_partkey % 6 AS c, p_partkey % 2 = 1 AS dark, 15 * (p_partkey % 4) AS ink FROM part),
        m AS (SELECT *, h * (a + c) * ink / CAST({PAGE[0] * PAGE[1]} AS DOUBLE) AS off FROM p), s AS (SELECT * FROM m WHERE ink > off + 25 AND h >= 3),
        b AS (SELECT part, 0 AS k, 3 AS x, CASE WHEN gap > 8 THEN a ELSE a + gap + c END AS w, h FROM s UNION ALL SELECT part, 1, 3 + a + gap, c, h FROM s WHERE gap > 8)
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY k) - 1 AS ord, CAST(x AS BIGINT) AS x, CAST(4 AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM b WHERE w >= 4""",
    "picture_faces": """WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS part, CAST(12 + p_partkey % 8 AS BIGINT) AS w, CAST(12 + p_partkey % 10 AS BIGINT) AS h, 1 + p_partkey % 7 AS dw, 1 + p_partkey % 9 AS dh FROM part),
        f AS (SELECT *, (w * h - dw * dh) / CAST(w * h AS DOUBLE) AS fill, ceil(dw / 2.0) * ceil(dh / 2.0) / (w * h // 4) AS dark FROM p)
        SELECT part, CAST(6 AS BIGINT) AS x, CAST(6 AS BIGINT) AS y, w, h, CAST(CASE WHEN dark BETWEEN 0.05 AND 0.60 THEN 0.94 ELSE 0.82 END AS DOUBLE) AS confidence FROM f WHERE w >= 14 AND h >= 14 AND w / CAST(h AS DOUBLE) BETWEEN 0.55 AND 1.45 AND fill BETWEEN 0.35 AND 0.95""",
    "image_redaction": f"""WITH px AS (SELECT CAST(p_partkey AS BIGINT) AS part, x, y, (x * (p_partkey % 7 + 1) * 9 + y * (p_partkey % 5 + 1) * 5 + (p_partkey % 7 + 1) * (p_partkey % 5 + 1)) % 256 AS v, x + 12 * y + 1 AS place, x BETWEEN 2 AND 9 AND y BETWEEN 2 AND 9 AS inside FROM part, range(12) a(x), range(12) b(y)),
        own AS (SELECT part, x, y, v FROM px WHERE inside), h AS {_BLUR('own', 'x', 'y')}, vb AS {_BLUR('h', 'y', 'x')}, bl AS (SELECT part, x, y, CAST(floor(avg(v) OVER (PARTITION BY part, (x - 2) // 4, (y - 2) // 4) + 0.5) AS BIGINT) AS v FROM own)
        SELECT px.part, CAST(sum(px.v * place) AS BIGINT) AS plain, CAST(sum(CASE WHEN inside THEN 0 ELSE px.v END * place) AS BIGINT) AS solid, CAST(sum(coalesce(bl.v, px.v) * place) AS BIGINT) AS pixelate, CAST(sum(coalesce(vb.v, px.v) * place) AS BIGINT) AS blur,
            CAST(7 AS BIGINT) AS height, CAST(max(CASE WHEN px.x = 0 AND px.y = 0 THEN px.v END) AS BIGINT) AS corner, CAST(7 AS BIGINT) AS width FROM px LEFT JOIN bl ON bl.part = px.part AND bl.x = px.x AND bl.y = px.y LEFT JOIN vb ON vb.part = px.part AND vb.x = px.x AND vb.y = px.y GROUP BY px.part""",
}
