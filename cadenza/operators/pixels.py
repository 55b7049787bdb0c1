"""Pixel operators: frames in, tables of letters and boxes out.

A frame is a row ``video_id, frame_id, frame_width, frame_height, pixels``, the
pixels as bytes of blue, green and red by the row. Masks live in numpy inside
Arrow batches; what leaves are small tables that ``bands`` works on. The
numbers follow the usual integer forms of grey, saturation and edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a component.
BOX = ("x1", "y1", "x2", "y2", "area")


@dataclass(frozen=True)
class Presence:
    """Fixed values of a detector of text: brightness, saturation, place and size of a line, and its letters."""

    bright: int = 165
    pale: int = 140
    top: float = 0.50
    bottom: float = 0.92
    widths: tuple = (0.12, 0.92)
    heights: tuple = (0.018, 0.12)
    centre: float = 0.42
    areas: tuple = (6, 1600)
    letters: int = 8


#: The stricter detector, for the first text of a video.
STRICT = Presence(170, 120, 0.45, 0.92, (0.3, 0.9), (0.025, 0.08), 0.3, (8, 1000), 12)


def grey(frame: np.ndarray) -> np.ndarray:
    b, g, r = (frame[..., k].astype(np.int32) for k in range(3))
    return (b * 1868 + g * 9617 + r * 4899 + 8192) >> 14


#: Of each brightness, 255 over it in 12 more bits.
_SHARE = np.r_[0, np.rint((255 << 12) / np.arange(1, 256))].astype(np.int32)


def saturation(frame: np.ndarray) -> np.ndarray:
    b, g, r = (frame[..., k] for k in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    return ((top - low) * _SHARE[top] + 2048) >> 12


def _slide(mask: np.ndarray, high: int, wide: int, pick, fill: bool) -> np.ndarray:
    """``pick`` over a window around each pixel; outside counts as ``fill``. A window is made of two that are half as long."""
    a, b = high // 2, wide // 2
    out = np.full((mask.shape[0] + 2 * a, mask.shape[1] + 2 * b), fill)
    out[a : a + mask.shape[0], b : b + mask.shape[1]] = mask
    for axis, size in ((0, 2 * a + 1), (1, 2 * b + 1)):
        have = 1
        while have < size:
            s = min(have, size - have)
            out = pick(out[:-s], out[s:]) if axis == 0 else pick(out[:, :-s], out[:, s:])
            have += s
    return out


def grown(mask: np.ndarray, high: int, wide: int) -> np.ndarray:
    return _slide(mask, high, wide, np.logical_or, False)


def closed(mask: np.ndarray, high: int, wide: int) -> np.ndarray:
    return _slide(grown(mask, high, wide), high, wide, np.logical_and, True)


def labels(mask: np.ndarray, corners: bool = True) -> tuple[np.ndarray, int]:
    """Numbers connected pixels from 1, through corners too or not; runs of rows are joined, not pixels."""
    h, w = mask.shape
    turn = np.zeros((h, w + 2), dtype=np.int8)
    turn[:, 1:-1] = mask
    turn = np.diff(turn, axis=1)
    ys, a = np.nonzero(turn == 1)
    b = np.nonzero(turn == -1)[1]
    # The runs of the row before that each run meets stand side by side.
    reach, row = int(corners), (ys - 1) * (w + 4)
    first = np.searchsorted(ys * (w + 4) + b, row + a - reach, "right")
    last = np.searchsorted(ys * (w + 4) + a, row + b + reach, "left")
    parent = list(range(len(ys)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    met = np.flatnonzero(first < last)
    for k, lo, hi in zip(met.tolist(), first[met].tolist(), last[met].tolist(), strict=True):
        for i in range(lo, hi):
            x, z = find(k), find(i)
            if x != z:
                parent[max(x, z)] = min(x, z)
    names, small = np.unique(np.array([find(k) for k in range(len(parent))], dtype=np.int64), return_inverse=True)
    out = np.zeros((h, w), dtype=np.int64)
    out[np.asarray(mask, dtype=bool)] = np.repeat(small + 1, b - a)
    return out, len(names)


def components(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """x1, y1, x2, y2 (exclusive) and area of each connected part."""
    lab, n = labels(mask, corners)
    ys, xs = np.nonzero(mask)
    k = lab[ys, xs] - 1
    out = np.zeros((n, 5), dtype=np.int64)
    out[:, :2] = np.iinfo(np.int64).max
    np.minimum.at(out[:, 0], k, xs)
    np.minimum.at(out[:, 1], k, ys)
    np.maximum.at(out[:, 2], k, xs + 1)
    np.maximum.at(out[:, 3], k, ys + 1)
    out[:, 4] = np.bincount(k, minlength=n)[:n]
    return out


def outlines(mask: np.ndarray) -> np.ndarray:
    """Boxes of the parts that no other part surrounds."""
    if not mask.any():
        return np.zeros((0, 5), dtype=np.int64)
    ring = np.pad(mask, 1)
    ground, _ = labels(~ring, corners=False)
    outside = ground == ground[0, 0]
    lab, n = labels(ring)
    seen = np.unique(lab[ring & grown(outside, 3, 3)])
    return components(mask)[seen[seen > 0] - 1]


def edges(g: np.ndarray, low: int = 80, high: int = 180) -> np.ndarray:
    """Thin edges: gradients over ``low`` that are largest across the edge and hang together with one over ``high``."""
    p = np.pad(g, 1, mode="edge")
    row = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    col = p[:-2] + 2 * p[1:-1] + p[2:]
    dy, dx = row[2:] - row[:-2], col[:, 2:] - col[:, :-2]
    m = np.abs(dx) + np.abs(dy)
    q = np.pad(m, 1)
    near = lambda y, x: q[1 + y : 1 + y + m.shape[0], 1 + x : 1 + x + m.shape[1]]
    ax, ay = np.abs(dx), np.abs(dy) << 15
    flat, steep = ay < ax * 13573, ay > ax * 13573 + (ax << 16)  # 13573: tan(22.5 degrees) in 15 bits
    same = (dx ^ dy) >= 0
    slant = np.where(same, (m > near(-1, -1)) & (m > near(1, 1)), (m > near(-1, 1)) & (m > near(1, -1)))
    top = np.where(flat, (m > near(0, -1)) & (m >= near(0, 1)), np.where(steep, (m > near(-1, 0)) & (m >= near(1, 0)), slant))
    weak = top & (m > low)
    lab, n = labels(weak)
    strong = np.unique(lab[weak & (m > high)])
    return np.isin(lab, strong[strong > 0])


def text_mask(frame: np.ndarray, known: tuple | None = None) -> np.ndarray:
    """Bright, pale pixels at edges, a little widened. ``known``: the frame's grey and saturation."""
    g, s = known or (grey(frame), saturation(frame))
    return grown((g > 185) & (s < 105) & grown(edges(g), 3, 3), 3, 5)


def added_mask(final: np.ndarray, original: np.ndarray) -> np.ndarray:
    """Text of the final frame where it differs from the original and the original has none near."""
    change = grey(np.maximum(final, original) - np.minimum(final, original)) > 18
    free = grown(change, 5, 9) & ~grown(text_mask(original), 9, 15)
    return grown(text_mask(final) & free, 3, 5)


def has_text(frame: np.ndarray, o: Presence = Presence(), known: tuple | None = None) -> bool:
    """Whether a line of enough letters stands in the frame."""
    h, w = frame.shape[:2]
    g, s = known or (grey(frame), saturation(frame))
    raw = (g > o.bright) & (s < o.pale)
    mask = raw.copy()
    mask[: int(h * o.top)] = False
    mask[int(h * o.bottom) :] = False
    for x1, y1, x2, y2, _ in outlines(grown(closed(mask, 7, 21), 3, 9)):
        if not (o.widths[0] * w <= x2 - x1 <= o.widths[1] * w and o.heights[0] * h <= y2 - y1 <= o.heights[1] * h and abs((x1 + x2) / 2 - w / 2) <= o.centre * w):
            continue
        c = components(raw[y1:y2, x1:x2])
        ok = (c[:, 4] >= o.areas[0]) & (c[:, 4] <= o.areas[1]) & (c[:, 2] - c[:, 0] >= 2) & (c[:, 3] - c[:, 1] >= 5)
        if ok.sum() >= o.letters:
            return True
    return False


def outline_boxes(frame: np.ndarray, top: float = 0.5, bottom: float = 0.86, known: tuple | None = None) -> np.ndarray:
    """Boxes that may hold source text, where bands have found none."""
    h, w = frame.shape[:2]
    g, s = known or (grey(frame), saturation(frame))
    mask = (g > 150) & (s < 150)
    mask[: int(h * top)] = False
    mask[int(h * min(bottom, 0.86)) :] = False
    c = outlines(grown(closed(mask, 7, 21), 3, 11))
    bw, bh = c[:, 2] - c[:, 0], c[:, 3] - c[:, 1]
    ok = (bw >= w * 0.18) & (bh >= max(16, h * 0.018)) & (bh <= h * 0.13) & (bw * bh >= w * h * 0.0025) & (np.abs((c[:, 0] + c[:, 2]) / 2 - w / 2) <= w * 0.25)
    return c[ok]


def low_brightness(frame: np.ndarray) -> float:
    """Mean of the bottom 28 %."""
    return float(frame[int(frame.shape[0] * 0.72) :].mean())


def picture(pixels: bytes | None, width: int, height: int) -> np.ndarray | None:
    """A frame's array; null where there are not as many bytes as it needs."""
    if pixels is None or len(pixels) != 3 * width * height or not width * height:
        return None
    return np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 3)


def analysed(frames: DataFrame) -> DataFrame:
    """``video_id, frame_id, readable, brightness, visible, visible_strict, components, boxes`` of each frame."""
    part = "array<struct<x1: bigint, y1: bigint, x2: bigint, y2: bigint, area: bigint>>"
    box = pa.list_(pa.struct([(k, pa.int64()) for k in BOX]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for pixels, w, h in zip(*(b.column(c).to_pylist() for c in ("pixels", "frame_width", "frame_height")), strict=True):
                f = picture(pixels, w or 0, h or 0)
                if f is None:
                    out.append((False, None, None, None, None, None))
                    continue
                listed = lambda c: [dict(zip(BOX, r, strict=True)) for r in c.tolist()]
                known = grey(f), saturation(f)
                out.append((True, low_brightness(f), has_text(f, known=known), has_text(f, STRICT, known), listed(components(text_mask(f, known))), listed(outline_boxes(f, known=known))))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = (pa.bool_(), pa.float64(), pa.bool_(), pa.bool_(), box, box)
            yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("frame_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["video_id", "frame_id", "readable", "brightness", "visible", "visible_strict", "components", "boxes"])

    t = dict(frames.dtypes)
    schema = f"video_id {t['video_id']}, frame_id {t['frame_id']}, readable boolean, brightness double, visible boolean, visible_strict boolean, components {part}, boxes {part}"
    return frames.select("video_id", "frame_id", "frame_width", "frame_height", "pixels").mapInArrow(run, schema)


def paired(finals: DataFrame, originals: DataFrame, keys: Sequence[str] = ("video_id", "frame_id")) -> DataFrame:
    """Frames of both by their number, other columns as ``final_...`` and ``original_...``: a frame that could not be read leaves the others' pairs alone."""
    named = lambda df, kind: df.select(*keys, *(F.col(c).alias(f"{kind}_{c}") for c in df.columns if c not in keys))
    return named(finals, "final").join(named(originals, "original"), list(keys))


def added(finals: DataFrame, originals: DataFrame) -> DataFrame:
    """``video_id, frame_id, frame_width, frame_height, readable, added_pixels, components`` of each pair of frames: the text that only the final one has.

    Frames: ``video_id, frame_id, frame_width, frame_height, pixels``. A pair
    is readable if both have as many bytes as their size, which is the same.
    """
    box = pa.list_(pa.struct([(k, pa.int64()) for k in BOX]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            sizes = (f"{kind}_frame_{side}" for kind in ("final", "original") for side in ("width", "height"))
            for w, h, ow, oh, final, original in zip(*(b.column(c).to_pylist() for c in (*sizes, "final_pixels", "original_pixels")), strict=True):
                f, o = picture(final, w or 0, h or 0), picture(original, ow or 0, oh or 0)
                if f is None or o is None or f.shape != o.shape:
                    out.append((False, None, None))
                    continue
                mask = added_mask(f, o)
                out.append((True, int(mask.sum()), [dict(zip(BOX, r, strict=True)) for r in components(mask).tolist()]))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            plain = [b.column(c) for c in ("video_id", "frame_id", "final_frame_width", "final_frame_height")]
            yield pa.RecordBatch.from_arrays([*plain, *(pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.int64(), box), strict=True))], names=["video_id", "frame_id", "frame_width", "frame_height", "readable", "added_pixels", "components"])

    pairs = paired(finals, originals).select("video_id", "frame_id", *(f"{kind}_{c}" for kind in ("final", "original") for c in ("frame_width", "frame_height", "pixels")))
    t = dict(pairs.dtypes)
    part = "array<struct<x1: bigint, y1: bigint, x2: bigint, y2: bigint, area: bigint>>"
    schema = f"video_id {t['video_id']}, frame_id {t['frame_id']}, frame_width {t['final_frame_width']}, frame_height {t['final_frame_height']}, readable boolean, added_pixels long, components {part}"
    return pairs.mapInArrow(run, schema)
