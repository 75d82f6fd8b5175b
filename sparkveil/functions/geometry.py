"""Boxes as Column expressions.  A box is four columns or a struct x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Round half towards positive infinity."""
    return F.floor(c + 0.5)


def box(x, y, w, h) -> Column:
    """An integer box: rounded, sizes at least zero; null if a part is missing or not finite."""
    parts = [F.try_to_number(p, F.lit("S999999999.99999")) if isinstance(p, str) else p.cast("double") for p in (x, y, w, h)]
    whole = [half_up(p).cast("long") for p in parts]
    good = parts[0].isNotNull()
    for p in parts:
        good = good & p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    zero = F.lit(0).cast("long")
    return F.when(good, F.struct(whole[0].alias("x"), whole[1].alias("y"), F.greatest(zero, whole[2]).alias("w"), F.greatest(zero, whole[3]).alias("h")))


def box_of_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return box(x0, y0, x1 - x0, y1 - y0)


def clamped(b: Column, width, height) -> Column:
    """A box with negative sizes flipped, cut to a canvas; null if nothing is left (P1d)."""
    x0, x1 = F.least(b.x, b.x + b.w), F.greatest(b.x, b.x + b.w)
    y0, y1 = F.least(b.y, b.y + b.h), F.greatest(b.y, b.y + b.h)
    zero = F.lit(0)
    x0, x1, y0, y1 = F.greatest(zero, x0), F.least(F.lit(width), x1), F.greatest(zero, y0), F.least(F.lit(height), y1)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def scaled(b: Column, s) -> Column:
    """A box in another resolution: rounded, at least one pixel wide and high."""
    one = F.lit(1).cast("long")
    return F.struct(half_up(b.x * s).cast("long").alias("x"), half_up(b.y * s).cast("long").alias("y"), F.greatest(one, half_up(b.w * s).cast("long")).alias("w"), F.greatest(one, half_up(b.h * s).cast("long")).alias("h"))


def target_size(width: Column, height: Column, longest: int = 768) -> Column:
    """struct(w, h, scale) with the longer side at most ``longest``; sizes of zero or less fail (P5)."""
    s = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    one = F.lit(1).cast("long")
    good = F.when((width > 0) & (height > 0), F.lit(True)).otherwise(F.raise_error(F.lit("image sizes must be positive")).cast("boolean"))
    return F.when(good, F.struct(F.greatest(one, half_up(width * s).cast("long")).alias("w"), F.greatest(one, half_up(height * s).cast("long")).alias("h"), s.alias("scale")))


def confidence(c: Column) -> Column:
    """OCR confidence: missing counts 0.85, above one is a percentage; clamped, four places."""
    v = F.coalesce(c.cast("double"), F.lit(0.85))
    v = F.when(v > 1, v / 100).otherwise(v)
    return half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * 10000) / 10000


def area(w: Column, h: Column) -> Column:
    return w * h


def overlap(a: tuple, b: tuple) -> Column:
    """Area of the intersection of two boxes (tuples of columns x, y, w, h)."""
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def iou(a: tuple, b: tuple) -> Column:
    inter = overlap(a, b)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def containment(a: tuple, b: tuple) -> Column:
    """Intersection over the smaller area."""
    least = F.least(a[2] * a[3], b[2] * b[3])
    return F.when(least > 0, overlap(a, b) / least).otherwise(0.0)


def gap(a: tuple, b: tuple) -> Column:
    """Distance between the edges of two boxes."""
    zero = F.lit(0)
    dx = F.greatest(zero, a[0] - (b[0] + b[2]), b[0] - (a[0] + a[2]))
    dy = F.greatest(zero, a[1] - (b[1] + b[3]), b[1] - (a[1] + a[3]))
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def centre(b: Column, vw, vh, scale=0.0, image_w=0.0, image_h=0.0, space=None) -> Column:
    """A target's centre in whole pixels of the viewport (P7); the first that holds of the centre decides.

    Both parts in (0, 1]: shares.  Space ``norm1000``, or ``1000`` with both at most 1000: thousandths.  A scale under one, within the
    scaled viewport and 15 %: scaled.  An image of another size (by more than 5), within it and 10 pixels: image pixels.  Else pixels.
    Scaled, image and plain pixels are kept inside the viewport.
    """
    x, y = b.x + b.w / 2, b.y + b.h / 2
    number = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    vw, vh, scale, image_w, image_h = map(number, (vw, vh, scale, image_w, image_h))
    space = space if isinstance(space, Column) else F.lit(space)
    shares = (x > 0) & (x <= 1) & (y > 0) & (y <= 1)
    thousandths = F.coalesce((space == "norm1000") | ((space == "1000") & (x <= 1000) & (y <= 1000)), F.lit(False))
    scaled = (scale > 0) & (scale < 1) & (x <= vw * scale * 1.15) & (y <= vh * scale * 1.15)
    other = (image_w > 0) & (image_h > 0) & ((F.abs(image_w - vw) > 5) | (F.abs(image_h - vh) > 5)) & (x <= image_w + 10) & (y <= image_h + 10)

    def along(v: Column, size: Column, image: Column) -> Column:
        kept = lambda c: F.greatest(F.lit(0.0), F.least(half_up(c).cast("double"), size - 1))
        return F.when(shares, half_up(v * size)).when(thousandths, half_up(v / 1000 * size)).when(scaled, kept(v / F.nullif(scale, F.lit(0.0)))).when(other, kept(v * (size / F.nullif(image, F.lit(0.0))))).otherwise(kept(v)).cast("double")

    return F.struct(along(x, vw, image_w).alias("x"), along(y, vh, image_h).alias("y"))


_PARTS = ("x", "y", "w", "h", "left", "top", "width", "height", "x0", "y0", "x1", "y1")


def parsed_box(j: Column) -> Column:
    """struct(many, one) of a box as JSON: its numbers if it is a list, its known fields if it is an object."""
    return F.struct(F.from_json(F.when(F.startswith(F.trim(j), F.lit("[")), j), "array<double>").alias("many"), F.from_json(F.when(F.startswith(F.trim(j), F.lit("{")), j), ", ".join(f"{p} double" for p in _PARTS)).alias("one"))


def box_from_json(j: Column, style: str = "merge") -> Column:
    """``box_of`` of a box as JSON."""
    return box_of(parsed_box(j), style)


def box_of(parsed: Column, style: str = "merge") -> Column:
    """struct(x, y, w, h) of doubles from a parsed box: a list, or an object by corner and size, by edges, or by two corners.

    merge (P1): rounded, sizes at least zero, null if it is no box.  dom (P1b): as it is, zeros if it is no box, no two corners.
    ocr (P1c): rounded, lists of exactly four, zeros if it is no box.  server (P1e): as it is, short lists are filled up, far off the page is null.
    """
    many, one = parsed["many"], parsed["one"]
    is_list, is_object = many.isNotNull(), one.isNotNull()
    get = lambda *names: F.coalesce(*[one[n] for n in names], F.lit(0.0))
    at = lambda k: F.coalesce(F.get(many, k), F.lit(0.0))
    box_ = lambda parts: F.struct(*[p.alias(n) for p, n in zip(parts, "xywh", strict=True)])
    listed = [at(k) for k in range(4)]
    sized = [get("x", "left"), get("y", "top"), get(*(("w", "width") if style in ("merge", "server") else ("width", "w"))), get(*(("h", "height") if style in ("merge", "server") else ("height", "h")))]
    corners = [F.least(get("x0"), get("x1")), F.least(get("y0"), get("y1")), F.abs(get("x1") - get("x0")), F.abs(get("y1") - get("y0"))]
    cornered = one["x0"].isNotNull() & one["x1"].isNotNull()
    if style == "merge":
        tidy = lambda p: box_([half_up(p[0]).cast("double"), half_up(p[1]).cast("double"), F.greatest(F.lit(0.0), half_up(p[2]).cast("double")), F.greatest(F.lit(0.0), half_up(p[3]).cast("double"))])
        return F.when(is_list & (F.size(many) >= 4), tidy(listed)).when(is_object & cornered, tidy(corners)).when(is_object, tidy(sized))
    none = box_([F.lit(0.0)] * 4)
    if style == "dom":
        return F.when(is_list & (F.size(many) >= 4), box_(listed)).when(is_object, box_(sized)).otherwise(none)
    if style == "ocr":
        tidy = lambda p: box_([half_up(v).cast("double") for v in p])
        return F.when(is_list & (F.size(many) == 4), tidy(listed)).when(is_object & cornered, tidy(corners)).when(is_object, tidy(sized)).otherwise(none)
    off = (F.size(many) >= 2) & ((at(0) < -100) | (at(1) < -100))
    return F.when(is_list & (F.size(many) > 0) & ~off, box_(listed)).when(is_object, box_(sized))


def unit(c: Column) -> Column:
    """A confidence clamped to [0, 1]; missing counts 1."""
    v = F.coalesce(F.nanvl(c.cast("double"), F.lit(1.0)), F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def converted(v: Column, scale: Column, to_viewport: bool = True) -> Column:
    """A coordinate from the scaled canvas to the viewport, or back; a scale of one or without sense only rounds."""
    plain = (scale <= 0) | (scale == 1) | scale.isNull()
    return half_up(F.when(plain, v).otherwise(v / scale if to_viewport else v * scale)).cast("long")


def overlaps(a: tuple, b: tuple, least: float = 0.0) -> Column:
    """Whether two boxes with an area intersect, by at least a share of the smaller one."""
    solid = (a[2] > 0) & (a[3] > 0) & (b[2] > 0) & (b[3] > 0)
    met = overlap(a, b) > 0
    return solid & met & (containment(a, b) >= least) if least > 0 else solid & met


def in_viewport(b: tuple, width, height) -> Column:
    """Whether any part of a box lies inside the viewport."""
    return (b[0] + b[2] > 0) & (b[1] + b[3] > 0) & (b[0] < width) & (b[1] < height)


def plausible(w: Column, h: Column) -> Column:
    """Whether a detection has the proportions of an element: aspect 0.4 to 8, 14 to 600 wide, 12 to 90 high."""
    return (h > 0) & (w / h).between(0.4, 8.0) & w.between(14, 600) & h.between(12, 90)


def on_page(b: tuple) -> Column:
    """Whether a box can be aimed at: not far off the page, with an area."""
    return (b[0] >= -500) & (b[1] >= -500) & (b[2] > 0) & (b[3] > 0)
