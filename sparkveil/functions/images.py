"""Image kernels on numpy arrays, and the Arrow functions that apply them to binary columns."""

from __future__ import annotations

import base64
import struct
import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_png(data: bytes) -> np.ndarray:
    """RGBA pixels of an 8-bit PNG (RGB, RGBA or grey, not interlaced)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        side = int((len(data) // 4) ** 0.5)  # raw pixels of a square
        return np.frombuffer(data[: side * side * 4], np.uint8).reshape(side, side, 4).copy()
    at, packed, width, height, colour = 8, b"", 0, 0, 0
    while at + 8 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, _, colour = struct.unpack(">IIBB", body[:10])
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    n = {6: 4, 2: 3, 4: 2}.get(colour, 1)
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * n)
    out = raw[:, 1:].copy()  # rows without a filter are right as they are
    for y in np.flatnonzero(raw[:, 0]).tolist():
        method, row = raw[y, 0], out[y]
        if method == 1:
            row[:] = np.cumsum(row.reshape(width, n), 0, np.uint8).ravel()
        elif method == 2:
            row += out[y - 1] if y else 0
        elif method in (3, 4):
            line, above = row.tolist(), out[y - 1].tolist() if y else [0] * row.size
            for x in range(len(line)):
                left, up, corner = (line[x - n] if x >= n else 0), above[x], (above[x - n] if x >= n else 0)
                guess = (left + up) // 2 if method == 3 else min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                line[x] = (line[x] + guess) & 255
            row[:] = line
    pixels = out.reshape(height, width, n)
    if n == 4:
        return pixels
    rgba = np.full((height, width, 4), 255, np.uint8)
    rgba[..., :3] = pixels[..., :3] if n >= 3 else pixels[..., :1]
    if n == 2:
        rgba[..., 3] = pixels[..., n - 1]
    return rgba


def encode_png(rgba: np.ndarray, level: int = -1) -> bytes:
    raw = np.concatenate([np.zeros((rgba.shape[0], 1), np.uint8), rgba.reshape(rgba.shape[0], -1)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", rgba.shape[1], rgba.shape[0], 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def mask(image: np.ndarray, box: tuple[int, int, int, int]) -> None:
    """Solid black (I1), in place."""
    x, y, w, h = box
    image[y : y + h, x : x + w] = (0, 0, 0, 255)


def pixelate(image: np.ndarray, box: tuple[int, int, int, int]) -> None:
    """Blocks of max(2, clamp(min(w, h) // 4, 4, 16)) pixels become their mean (I2), in place."""
    x, y, w, h = box
    size = max(2, min(16, max(4, min(w, h) // 4)))
    for top in range(y, y + h, size):
        for left in range(x, x + w, size):
            part = image[top : min(top + size, y + h), left : min(left + size, x + w)]
            part[...] = np.floor(part.reshape(-1, 4).mean(0) + 0.5).astype(np.uint8)


def box_blur(image: np.ndarray, box: tuple[int, int, int, int], radius: int = 8, passes: int = 1) -> None:
    """Moving average with clamped edges (W4, I3), in place; three passes approximate a Gaussian."""
    x, y, w, h = box
    part = image[y : y + h, x : x + w].astype(np.int64)
    r = min(radius, 12 if passes == 3 else 10)
    for _ in range(passes):
        for axis in (1, 0):
            n = part.shape[axis]
            at = np.clip(np.arange(-r, n + r), 0, n - 1)
            total = np.cumsum(np.take(part, at, axis), axis)
            zero = np.zeros_like(np.take(total, [0], axis))
            total = np.concatenate([zero, total], axis)
            window = np.take(total, np.arange(2 * r + 1, n + 2 * r + 1), axis) - np.take(total, np.arange(n), axis)
            part = (2 * window + 2 * r + 1) // (2 * (2 * r + 1))
    image[y : y + h, x : x + w] = part.astype(np.uint8)


def redact(image: np.ndarray, boxes: list[tuple[int, int, int, int]], style: str = "gaussian") -> np.ndarray:
    """Cover boxes: solid only if asked for, else blurred (I4); boxes are cut to the image."""
    out = image.copy()
    for x, y, w, h in boxes:
        x0, y0, x1, y1 = max(0, x), max(0, y), min(out.shape[1], x + w), min(out.shape[0], y + h)
        if x1 > x0 and y1 > y0:
            own = (x0, y0, x1 - x0, y1 - y0)
            {"solid": lambda b: mask(out, b), "pixelate": lambda b: pixelate(out, b), "blur": lambda b: box_blur(out, b), "gaussian": lambda b: box_blur(out, b, 12, 3)}[style](own)
    return out


def resize(image: np.ndarray, longest: int = 768) -> np.ndarray:
    """Nearest neighbour, longer side at most ``longest``."""
    h, w = image.shape[:2]
    s = min(1.0, longest / max(h, w))
    nh, nw = max(1, int(h * s + 0.5)), max(1, int(w * s + 0.5))
    return image[(np.arange(nh) * h // nh)[:, None], np.arange(nw) * w // nw]


def tensor(image: np.ndarray, side: int = 128) -> np.ndarray:
    """Planar CHW float32 in [0, 1] of a nearest-neighbour square."""
    h, w = image.shape[:2]
    return (image[(np.arange(side) * h // side)[:, None], np.arange(side) * w // side, :3].astype(np.float32) / 255).transpose(2, 0, 1)


def decode_boxes(rows: np.ndarray, width: int, height: int, least: float) -> list[tuple]:
    """(class, score, x, y, w, h) of model rows cx, cy, w, h, scores...; first class wins ties."""
    out = []
    for r in rows:
        scores = r[4:]
        k = int(scores.argmax())
        if scores[k] >= least:
            out.append((k, float(scores[k]), int((r[0] - r[2] / 2) * width + 0.5), int((r[1] - r[3] / 2) * height + 0.5), int(r[2] * width + 0.5), int(r[3] * height + 0.5)))
    return out


def _luminance(image: np.ndarray) -> np.ndarray:
    return 0.299 * image[..., 0] + 0.587 * image[..., 1] + 0.114 * image[..., 2]  # in this order: a pixel's value is the same in any cut


class _Field:
    """Cells of a picture that can still be taken; areas are taken from it, last reached first, up to a number of cells.

    Where an area is larger than that number, its extent depends on the order of steps, which is part of the rule: up, down,
    left, right.  Cells reached but no longer visited are taken too.
    """

    def __init__(self, height: int, width: int) -> None:
        self.height, self.width, self.wide = height, width, width + 2
        self.free = np.zeros((height + 2, width + 2), bool)  # with a closed border
        self.free[1:-1, 1:-1] = True

    def seeds(self):
        """Free cells of a coarse grid, two cells off the border; asked again after each area."""
        down, across = max(2, self.height // 64), max(2, self.width // 64)
        for i, j in np.argwhere(self.free[3 : self.height - 1 : down, 3 : self.width - 1 : across]).tolist():
            y, x = 2 + i * down, 2 + j * across
            if self.free[y + 1, x + 1]:
                yield y, x

    def area(self, y: int, x: int, like: np.ndarray, most: int) -> tuple[int, int, int, int, int]:
        """x, y, w, h and cells of the area of ``like`` around a cell."""
        open_ = self.free.copy()
        open_[1:-1, 1:-1] &= like
        flat, start = open_.ravel(), (y + 1) * self.wide + x + 1
        reached, taken, visited = [start], [start], []
        flat[start] = False
        while reached and len(visited) < most:
            at = reached.pop()
            visited.append(at)
            fresh = [n for n in (at + 1, at - 1, at + self.wide, at - self.wide) if flat[n]]
            for n in fresh:
                flat[n] = False
            reached += fresh
            taken += fresh
        self.free.ravel()[taken] = False
        rows, columns = np.divmod(np.array(visited), self.wide)
        return int(columns.min()) - 1, int(rows.min()) - 1, int(np.ptp(columns)) + 1, int(np.ptp(rows)) + 1, len(visited)

    def areas(self, most: int):
        """Areas of the free cells, as ``area`` gives them, from each seed.

        One of no more than ``most`` cells is all that is connected, in whatever order: it is put together from runs of cells in
        rows, each met once.  What is larger is walked cell by cell, from every seed that the walks before have left free.
        """
        flat = self.free.ravel()
        runs = (np.flatnonzero(flat[1:] != flat[:-1]) + 1).tolist()
        first, last = runs[::2], runs[1::2]  # the border is closed: a run ends in its row
        met = bytearray(len(first))
        for y, x in self.seeds():
            k = bisect_right(first, (y + 1) * self.wide + x + 1) - 1
            if met[k]:  # and yet free
                yield self.area(y, x, self.free[1:-1, 1:-1], most)
                continue
            met[k], own = 1, [k]
            for k in own:  # grows
                for beside in (-self.wide, self.wide):
                    low, high = first[k] + beside, last[k] + beside
                    j = bisect_right(last, low)
                    while j < len(first) and first[j] < high:
                        if not met[j]:
                            met[j] = 1
                            own.append(j)
                        j += 1
            n = sum(last[k] - first[k] for k in own)
            if n > most:
                yield self.area(y, x, self.free[1:-1, 1:-1], most)
                continue
            for k in own:
                flat[first[k] : last[k]] = False
            rows, left, right = [first[k] // self.wide for k in own], min(first[k] % self.wide for k in own), max(last[k] % self.wide for k in own)
            yield left - 1, min(rows) - 1, right - left, max(rows) - min(rows) + 1, n


# Most cells of an area of skin, and of one behind an edge.
FACE_CELLS, EDGE_CELLS = 15_000, 800


def faces(image: np.ndarray, most: int = 16) -> list[tuple[int, int, int, int, float]]:
    """Skin-coloured areas with a face's proportions (I5), in scan order: x, y, w, h, confidence.

    Sides of 14 pixels and 50 pixels of skin at least, aspect 0.55 to 1.45, fill 0.35 to 0.95; a share of dark pixels of 0.05 to
    0.60 (eyes, mouth) raises the confidence from 0.82 to 0.94.
    """
    if min(image.shape[:2]) < 16:
        return []
    r, g, b = np.ascontiguousarray(np.moveaxis(image[..., :3], 2, 0), np.int16)
    skin = (r >= 50) & (g >= 30) & (b >= 20) & (r > b) & (r - g >= 12) & (r - np.minimum(g, b) >= 15)  # red is the largest
    if np.count_nonzero(skin) < 30:
        return []
    field, out = _Field(*skin.shape), []
    field.free[1:-1, 1:-1] = skin
    for x, y, w, h, n in field.areas(FACE_CELLS):
        if w >= 14 and h >= 14 and n >= 50 and 0.55 <= w / h <= 1.45 and 0.35 <= n / (w * h) <= 0.95:
            dark = np.count_nonzero(_luminance(image[y : y + h : 2, x : x + w : 2]) < 110) / max(1, w * h // 4)
            out.append((x, y, w, h, 0.94 if 0.05 <= dark <= 0.60 else 0.82))
            if len(out) == most:
                break
    return out


#: What an area behind an edge is, the first that holds of its width and height.
_LABELS = (("input", lambda w, h: w >= 3 * h and h <= 45), ("icon", lambda w, h: 0.8 <= w / h <= 1.3 and max(w, h) <= 48), ("text", lambda w, h: w > 4 * h or h <= 18), ("button", lambda w, h: True))


def ui_proposals(image: np.ndarray, most: int = 32) -> list[tuple[int, int, int, int, str, float]]:
    """Areas behind an edge as UI candidates (I6), in scan order: x, y, w, h, label, confidence.

    An edge is a step of more than 35 to the right or down; its area are the pixels within 45 of the one before it.  Pictures
    of a contrast under 18 (sampled) have none; 12 by 10 pixels at least, under 95 % of the picture's sides.
    """
    height, width = image.shape[:2]
    if height < 8 or width < 8:
        return []
    light = np.floor(_luminance(image) + 0.5).astype(int)
    if np.ptp(light.ravel()[:: max(1, light.size // 1000)]) < 18:
        return []
    step = np.zeros_like(light)
    step[:-1, :-1] = np.maximum(abs(np.diff(light, axis=1))[:-1], abs(np.diff(light, axis=0))[:, :-1])
    field, out = _Field(height, width), []
    for y, x in field.seeds():
        if step[y, x] > 35:
            left, top, w, h, _ = field.area(y, x, abs(light - light[y, x]) < 45, EDGE_CELLS)
            if 12 <= w < 0.95 * width and 10 <= h < 0.95 * height:
                label = next(name for name, holds in _LABELS if holds(w, h))
                out.append((left, top, w, h, label, round(float(np.clip(0.70 + step[y, x] / 255 * 0.25, 0.65, 0.96)), 4)))
    return out[:most]


def _runs(on: np.ndarray, gap: int = 0) -> list[tuple[int, int]]:
    """First and last place of each run of true values; runs at most ``gap`` apart are one."""
    at = np.flatnonzero(on)
    return [(int(r[0]), int(r[-1])) for r in np.split(at, np.flatnonzero(np.diff(at) > gap + 1) + 1)] if at.size else []


def text_lines(image: np.ndarray, contrast: int = 25, least_height: int = 3, least_width: int = 4, most_gap: int = 8) -> list[tuple[int, int, int, int]]:
    """Boxes of words in lines (I9, W3, A19): pixels that stand out from the mean on the far side of the ground.

    A line is a run of rows with enough such pixels; it is cut where more than ``most_gap`` columns are empty.
    """
    light = np.floor(image[..., :3].astype(int) @ (299, 587, 114) / 1000 + 0.5)
    mean = light.mean()
    on = light > mean + contrast if mean < 128 else light < mean - contrast
    lines = [(top, low) for top, low in _runs(on.sum(1) >= least_width) if low - top + 1 >= least_height]
    return [(x, top, right - x + 1, low - top + 1) for top, low in lines for x, right in _runs(on[top : low + 1].any(0), most_gap) if right - x + 1 >= least_width]


def redact_images(style: str = "gaussian"):
    """Arrow function (image binary, boxes array<struct<x,y,w,h>>) -> redacted PNG."""

    @F.pandas_udf(T.BinaryType())
    def run(images: pd.Series, boxes: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else encode_png(redact(decode_png(i), [(b["x"], b["y"], b["w"], b["h"]) for b in (boxes.iloc[k] if boxes.iloc[k] is not None else [])], style)) for k, i in enumerate(images)])

    return run


def from_data_url(url: str) -> bytes:
    return base64.b64decode(url.split(",", 1)[1] if url.startswith("data:") else url)
