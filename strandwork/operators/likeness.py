"""Likeness of frames given as pixel tables: background masks, frames as vectors, and similarities of all pairs in tiles.

The similarity of two frames is 100 less the root of the mean squared difference of their colours, weighted by how far
both are visible, over the pixels that are not background in both. Where a clip's background is stable, each frame masks
its own: by the hue of its corners if at least three are coloured alike, else by grey. A frame's pixels become one vector,
or, where they come in one row as bytes, stay packed; frames meet, packed, in square tiles of their places, and a tile's
pairs are products of two blocks of vectors; holds are found as a clip's frames pass by. frame_similarity is the same
measure of two vectors as a column, for the operators that take a similarity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.functions.color import hsv, hue_distance
from strandwork.operators.manifests import looked_at, stable_background

#: Side of a corner's patch; saturation of a colour, spread of one hue, alpha of a background pixel, distance
#: of a grey background's alpha; alpha at which a pixel is fully visible.
PATCH, SATURATION, HUE, CLEAR, GREY, FULL = 16, 0.15, 15.0, 65, 100, 40
#: Frames of a tile's side, at least, and where neighbours meet; rows of tiles of a clip; most bytes of a side; shares of
#: the tiles for each core.
TILE, NARROW, ROWS, HELD, SHARES = 512, 32, 8, 2**24, 32
#: Frames of a side that meet at a time, pixels that are multiplied at a time, rows of a strip of their results.
SIDE, PIXELS, STRIP = 1024, 128, 32
#: What a full difference of visibility counts.
SEEN = 255 * 255 * 0.25
#: Frames of a block of a clip that is folded, and of the first look ahead of an anchor.
BLOCK, LOOK = 256, 16


def corners(px: DataFrame, clip: Sequence[str], width: int, height: int, patch: int = PATCH) -> DataFrame:
    """clip, frame_index, corner (0 to 3: top left, top right, and below), h (circular mean), s, a (means)."""
    size = min(patch, width, height)
    left, right, top, bottom = F.col("x") < size, F.col("x") >= width - size, F.col("y") < size, F.col("y") >= height - size
    inside = F.array_compact(F.array(*[F.when(across & down, i) for i, (down, across) in enumerate([(top, left), (top, right), (bottom, left), (bottom, right)])]))
    each = px.withColumn("c", hsv(F.col("r"), F.col("g"), F.col("b"))).select(*clip, "frame_index", "a", "c.h", "c.s", F.explode(inside).alias("corner"))
    turn = F.radians("h")
    sums = each.groupBy(*clip, "frame_index", "corner").agg(F.avg(F.sin(turn)).alias("sin"), F.avg(F.cos(turn)).alias("cos"), F.avg("s").alias("s"), F.avg("a").alias("a"))
    return sums.select(*clip, "frame_index", "corner", F.pmod(F.degrees(F.atan2("sin", "cos")) + 360, F.lit(360.0)).alias("h"), "s", "a")


def backgrounds(px: DataFrame, clip: Sequence[str], width: int, height: int, patch: int = PATCH) -> DataFrame:
    """clip, frame_index, stable, hue, grey: whether the clip's background is stable, and what the frame's is: a hue, or
    the middle alpha of its grey corners, or neither."""
    found = corners(px, clip, width, height, patch)
    coloured = F.col("s") >= SATURATION
    turn = F.when(coloured, F.radians("h"))
    frames = found.groupBy(*clip, "frame_index").agg(
        F.count_if(coloured).alias("n"), F.avg(F.sin(turn)).alias("sin"), F.avg(F.cos(turn)).alias("cos"),
        F.sort_array(F.collect_list(F.when(~coloured, F.col("a")))).alias("greys"),
    )
    length = F.sqrt(F.col("sin") * F.col("sin") + F.col("cos") * F.col("cos"))
    alike = (length >= 1) | (F.degrees(F.sqrt(-2 * F.log(length))) < HUE)
    hue = F.when((F.col("n") >= 3) & alike, F.pmod(F.degrees(F.atan2("sin", "cos")) + 360, F.lit(360.0)))
    grey = F.when((F.col("n") < 3) & (F.size("greys") >= 3), F.get("greys", F.floor(F.size("greys") / 2).cast("int")))
    return frames.join(stable_background(found, clip), list(clip)).select(*clip, "frame_index", "stable", hue.alias("hue"), grey.alias("grey"))


def vectors(px: DataFrame, clip: Sequence[str], width: int, height: int, patch: int = PATCH) -> DataFrame:
    """clip, frame_index, pixels: each frame's pixels in reading order as (r, g, b, a, out, clear).

    out: the frame's own background; clear: too transparent to be compared if the other frame's pixel is, too. A frame is
    one row, so frames should be samples of a fixed size.
    """
    known = px.join(backgrounds(px, clip, width, height, patch), [*clip, "frame_index"])
    colour = hsv(F.col("r"), F.col("g"), F.col("b"))
    of_hue = (colour["s"] >= SATURATION) & (hue_distance(colour["h"], F.col("hue")) < HUE)
    of_grey = (colour["s"] < SATURATION) & (F.abs(F.col("a") - F.col("grey")) < GREY)
    described = F.col("stable") & (F.col("hue").isNotNull() | F.col("grey").isNotNull())
    out = described & ((F.col("a") < CLEAR) | F.when(F.col("hue").isNotNull(), of_hue).otherwise(of_grey))
    clear = F.col("a") < F.when(F.col("stable"), CLEAR).otherwise(1)
    flag = lambda c, name: F.coalesce(c, F.lit(False)).cast("double").alias(name)
    pixel = F.struct("y", "x", *[F.col(c).cast("double").alias(c) for c in "rgba"], flag(out, "out"), flag(clear, "clear"))
    rows = known.groupBy(*clip, "frame_index").agg(F.sort_array(F.collect_list(pixel)).alias("pixels"))
    return rows.withColumn("pixels", F.transform("pixels", lambda p: p.dropFields("x", "y")))


def _weight(a: Column) -> Column:
    t = F.least(a / FULL, F.lit(1.0))
    return t * t * (3 - 2 * t)


def frame_similarity(a: Column, b: Column) -> Column:
    """Similarity (up to 100) of two vectors of pixels; 100 where nothing is compared."""

    def difference(p: Column, q: Column) -> Column:
        u, v = _weight(p["a"]), _weight(q["a"])
        apart = [p[c] * (p["a"] / 255) - q[c] * (q["a"] / 255) for c in "rgb"]
        off = u * v * (sum((d * d for d in apart[1:]), apart[0] * apart[0]) / 3) + (u - v) * (u - v) * (255 * 255 * 0.25)
        skipped = ((p["out"] == 1) & (q["out"] == 1)) | ((p["clear"] == 1) & (q["clear"] == 1))
        return F.when(~skipped, off)

    each = F.filter(F.zip_with(a, b, difference), lambda d: d.isNotNull())
    total = F.aggregate(each, F.lit(0.0), lambda x, d: x + d)
    return F.when(F.size(each) == 0, 100.0).otherwise((1 - F.sqrt(total / F.size(each)) / 255) * 100)


@F.arrow_udf(T.BinaryType())
def _packed(frames: pa.Array) -> pa.Array:
    """A frame's pixels as bytes: one a number where all are whole and from 0 to 255, else a double each."""
    flat = np.stack([np.asarray(f) for f in frames.flatten().flatten()], -1)
    ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(frames).to_numpy(zero_copy_only=False))]).astype(np.int64)
    small = ((flat >= 0) & (flat <= 255) & (flat == np.floor(flat))).all(-1)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out.append(b"B" + flat[a:b].astype(np.uint8).tobytes() if small[a:b].all() else b"d" + flat[a:b].tobytes())
    return pa.array(out, pa.binary())


def _hsv(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue and saturation, as ``color.hsv``, of the channels (r, g, b) of pixels."""
    r, g, b = (c[..., i].astype(np.float64) for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    with np.errstate(divide="ignore", invalid="ignore"):
        sector = np.where(top == r, (g - b) / d, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) * 60
        return np.where(d == 0, 0.0, np.where(sector < 0, sector + 360, sector)), np.where(top == 0, 0.0, d / top)


def _turns(sin: np.ndarray, cos: np.ndarray) -> np.ndarray:
    return (np.degrees(np.arctan2(sin, cos)) + 360) % 360.0


def _corner_means(rgba: np.ndarray, h: np.ndarray, s: np.ndarray, width: int, patch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``corners`` of whole frames: h, s and a as frame x corner."""
    x, y = np.arange(rgba.shape[1]) % width, np.arange(rgba.shape[1]) // width
    size, height = min(patch, width, int(y[-1]) + 1), int(y[-1]) + 1
    turn, found = np.radians(h), []
    for corner in range(4):
        at = np.flatnonzero((y >= height - size if corner > 1 else y < size) & (x >= width - size if corner % 2 else x < size))
        found.append((_turns(np.sin(turn[:, at]).mean(-1), np.cos(turn[:, at]).mean(-1)), s[:, at].mean(-1), rgba[:, at, 3].mean(-1)))
    return tuple(np.stack(each, -1) for each in zip(*found, strict=True))


def _images(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, frame x pixel x (r, g, b, a)) of a column of bytes, for each size of frames."""
    each = column.to_pylist()
    sizes = np.array([len(v) for v in each])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.frombuffer(b"".join([each[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1, 4)


def masked(images: DataFrame, clip: Sequence[str], width: int, patch: int = PATCH) -> DataFrame:
    """clip, frame_index, pixels: the same as ``packed`` makes of ``vectors``, of frames whose pixels are whole.

    images: clip, frame_index, rgba: four bytes a pixel in reading order. A frame stays in its row, and only the corners of
    the five frames that show whether a clip's background is stable leave it.
    """

    @F.arrow_udf("array<struct<h:double,s:double,a:double>>")
    def shown(rgba: pa.Array) -> pa.Array:
        out = np.zeros((len(rgba), 4, 3))
        for at, px in _images(rgba):
            out[at] = np.stack(_corner_means(px, *_hsv(px), width, patch), -1)
        flat = pa.StructArray.from_arrays([pa.array(out[..., i].ravel()) for i in range(3)], ["h", "s", "a"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rgba) + 1) * 4, pa.int32()), flat)

    @F.arrow_udf(T.BinaryType())
    def flagged(rgba: pa.Array, stable: pa.Array) -> pa.Array:
        is_stable, out = stable.to_numpy(zero_copy_only=False).astype(bool), [b""] * len(rgba)
        for at, px in _images(rgba):
            h, s = _hsv(px)
            a = px[..., 3].astype(np.float64)
            hues, saturations, alphas = _corner_means(px, h, s, width, patch)
            coloured = saturations >= SATURATION
            n, turn = coloured.sum(-1), np.radians(hues)
            with np.errstate(divide="ignore", invalid="ignore"):
                sin, cos = ((f(turn) * coloured).sum(-1) / n for f in (np.sin, np.cos))
                length = np.sqrt(sin * sin + cos * cos)
                alike = (length >= 1) | (np.degrees(np.sqrt(-2 * np.log(length))) < HUE)
            greys = np.sort(np.where(coloured, np.inf, alphas), -1)
            grey = greys[np.arange(len(px)), (4 - n) // 2]
            of_hue, of_grey = (n >= 3) & alike, n <= 1
            apart = np.abs(h - np.where(of_hue, _turns(sin, cos), 0)[:, None]) % 360
            near = np.where(of_hue[:, None], (s >= SATURATION) & (np.minimum(apart, 360 - apart) < HUE), (s < SATURATION) & (np.abs(a - np.where(of_grey, grey, 0)[:, None]) < GREY))
            described = is_stable[at] & (of_hue | of_grey)
            flags = described[:, None] & ((a < CLEAR) | near), a < np.where(is_stable[at], CLEAR, 1)[:, None]
            rows = np.concatenate([px, np.stack(flags, -1).astype(np.uint8)], -1)
            for i, row in zip(at.tolist(), rows, strict=True):
                out[i] = b"B" + row.tobytes()
        return pa.array(out, pa.binary())

    n = F.col("_n")
    last = images.groupBy(*clip).agg((F.max("frame_index") + 1).alias("_n"))
    seen = images.join(F.broadcast(last.select(*clip, F.explode(looked_at(n)).alias("frame_index"))), [*clip, "frame_index"], "left_semi")
    found = seen.select(*clip, "frame_index", F.posexplode(shown("rgba")).alias("corner", "c")).select(*clip, "frame_index", "corner", "c.*")
    known = images.join(F.broadcast(stable_background(found, clip)), list(clip))
    return known.select(*clip, "frame_index", flagged("rgba", "stable").alias("pixels"))


def packed(frames: DataFrame) -> DataFrame:
    """frames of ``vectors`` with their pixels as bytes, as they are shuffled; those of ``masked`` are already."""
    return frames if frames.schema["pixels"].dataType == T.BinaryType() else frames.withColumn("pixels", _packed("pixels"))


def _block(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Packed frames of one size: frame x pixel x (r, g, b, a, out, clear)."""
    each = [np.frombuffer(v[1:], v[:1].decode()) for v in column.to_pylist()]
    return np.stack(each).reshape(len(each), -1, 6)


def _opacity(a: np.ndarray) -> np.ndarray:
    t = np.minimum(a / FULL, 1.0)
    return t * t * (3 - 2 * t)


class _Tile:
    """Similarities of the frames of two blocks, as products of what is known of either.

    The difference of two pixels is u v |p - q|^2 / 3 + SEEN (u - v)^2 = (u (p^2 / 3 - 2 SEEN)) v + u (v q^2 / 3) -
    2 / 3 sum (u p_c) (v q_c) + SEEN u^2 + SEEN v^2; what is not compared, as it is background or clear in both, is taken
    off by the same products of the flagged pixels. So a block's differences are one matrix product for some pixels.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray):
        skipped = (left[..., 4].all(0) & right[..., 4].all(0)) | (left[..., 5].all(0) & right[..., 5].all(0))
        if skipped.any():  # in all pairs of the tile
            left, right = left[:, ~skipped], right[:, ~skipped]
        self.left, self.right = left, right
        both = [(side[..., 4] != 0, side[..., 5] != 0) for side in (left, right)]
        out, clear = (all(side[k].any() for side in both) for k in (0, 1))
        nested = all(not (c & ~o).any() for o, c in both)  # clear within the background only: both flags are the second
        self.flags = [(-1, 4)] * out + ([] if nested else [(-1, 5)] * clear + [(1, 45)] * (out and clear))
        self.felt = {f: any((self._flag(side, f) * side[..., 3]).any() for side in (left, right)) for _, f in self.flags}

    @staticmethod
    def _flag(pixels: np.ndarray, which: int) -> np.ndarray:
        return pixels[..., 4] * pixels[..., 5] if which == 45 else pixels[..., which]

    def _known(self, pixels: np.ndarray, is_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's pixels: the factors of the products, and each frame's sum of SEEN u^2."""
        each = np.ascontiguousarray(np.moveaxis(pixels, -1, 0), np.float64)
        u, opaque = _opacity(each[3]), each[3] / 255
        colours = [each[c] * opaque for c in range(3)]
        square, own = sum((c * c for c in colours[1:]), colours[0] * colours[0]) * u / 3, SEEN * u * u
        one = [square - 2 * SEEN * u, u, *[c * (u * (-2 / 3)) for c in colours]] if is_left else [u, square, *[c * u for c in colours]]
        parts, ones = list(one), np.ones_like(u)
        for sign, which in self.flags:
            if self.felt[which]:
                flag = self._flag(pixels, which).astype(np.float64)
                parts += [(sign * flag if is_left else flag) * f for f in [*one, *([own, ones] if is_left else [ones, own])]]
        return np.concatenate(parts, -1), own.sum(-1)

    def similarity(self, rows: slice, cols: slice) -> np.ndarray:
        left, right = self.left[rows], self.right[cols]
        off, compared = None, np.full((len(left), len(right)), float(left.shape[1]), np.float32)
        for sign, which in self.flags:  # whole numbers
            compared += sign * (self._flag(left, which).astype(np.float32) @ self._flag(right, which).astype(np.float32).T)
        own, other = np.zeros(len(left)), np.zeros(len(right))
        for at in range(0, left.shape[1], PIXELS):
            (f, a), (g, b) = self._known(left[:, at : at + PIXELS], True), self._known(right[:, at : at + PIXELS], False)
            part = f @ g.T
            off, own, other = part if off is None else off + part, own + a, other + b
        if off is None:
            return np.full(compared.shape, 100.0)
        for at in range(0, len(off), STRIP):  # a strip stays in the processor's cache
            s, n = off[at : at + STRIP], compared[at : at + STRIP]
            s += own[at : at + STRIP, None]
            s += other
            np.maximum(s, 0, out=s)
            s /= np.maximum(n, 1)
            np.sqrt(s, out=s)
            s /= 255
            np.subtract(1, s, out=s)
            s *= 100
            if not n.all():
                s[n == 0] = 100.0
        return off


def _one_by_one(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarities of the frames of two blocks at the same places, or of one frame to a block's."""
    p, q = left.astype(np.float64), right.astype(np.float64)
    u, v = _opacity(p[..., 3]), _opacity(q[..., 3])
    apart = p[..., :3] * (p[..., 3:4] / 255) - q[..., :3] * (q[..., 3:4] / 255)
    off = u * v * ((apart * apart).sum(-1) / 3) + (u - v) * (u - v) * (255 * 255 * 0.25)
    compared = ~((p[..., 4] == 1) & (q[..., 4] == 1) | (p[..., 5] == 1) & (q[..., 5] == 1))
    n = compared.sum(-1)
    return np.where(n > 0, (1 - np.sqrt((off * compared).sum(-1) / np.maximum(n, 1)) / 255) * 100, 100.0)


class _Fold:
    """A clip's holds so far: its frames come in order and in blocks, and only the last one and the anchor are kept."""

    def __init__(self, threshold: float):
        self.threshold, self.n, self.last, self.anchor, self.anchor_index, self.early = threshold, 0, None, None, None, []

    def held(self, places: list[int], block: np.ndarray) -> list[tuple[int, int]]:
        """(frame, anchor) of the holds that are certain now; clips of fewer than three frames have none."""
        found, at = self.early, 0
        if self.last is None:
            self.last, self.anchor, self.anchor_index, at = block[0], block[0], places[0], 1
        near = _one_by_one(np.concatenate([self.last[None], block[:-1]]), block) >= self.threshold
        look = LOOK
        while at < len(block):
            like = near[at : at + look] & (_one_by_one(self.anchor[None], block[at : at + look]) >= self.threshold)
            run = int(np.argmin(like)) if not like.all() else len(like)
            found += [(p, self.anchor_index) for p in places[at : at + run]]
            at += run
            look *= 2
            if run < len(like):
                self.anchor, self.anchor_index, at, look = block[at], places[at], at + 1, LOOK
        self.last, self.n = block[-1], self.n + len(block)
        self.early, found = ([], found) if self.n >= 3 else (found, [])
        return found


def duplicate_holds(frames: DataFrame, clip: Sequence[str], threshold: float = 88.0) -> DataFrame:
    """frames of ``vectors`` -> clip, frame_index, match_index, threshold: ``sequences.duplicate_holds`` of pixels.

    A clip's frames pass through one task in their order, and the task keeps two of them and a block, however long a clip.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    rows = packed(frames).select(*clip, F.col("frame_index").cast("long").alias("frame_index"), "pixels").repartition(*clip).sortWithinPartitions(*clip, "frame_index")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.slice(start, BLOCK)
                keys, places = list(zip(*[part.column(c).to_pylist() for c in clip], strict=True)), part.column("frame_index").to_pylist()
                a = 0
                while a < len(keys):
                    b = next((i for i in range(a + 1, len(keys)) if keys[i] != keys[a]), len(keys))
                    if state is None or keys[a] != key:
                        key, state = keys[a], _Fold(threshold)
                    found = state.held(places[a:b], _block(part.column("pixels").slice(a, b - a)))
                    if found:
                        same = [pa.repeat(part.column(c)[a], len(found)) for c in clip]
                        yield pa.RecordBatch.from_arrays([*same, *[pa.array(x, pa.int64()) for x in zip(*found, strict=True)], pa.array([threshold] * len(found), pa.float64())], names=[*clip, "frame_index", "match_index", "threshold"])
                    a = b

    return rows.mapInArrow(fold, f"{', '.join(f'{c} {kinds[c]}' for c in clip)}, frame_index long, match_index long, threshold double")


def _tiles(frames: DataFrame, clip: Sequence[str], most: int | None, tile: int | None) -> DataFrame:
    """Packed frames in the tiles (row, col) that they are in, over the pairs of places i < j up to ``most`` apart.

    Without a width, a clip has ROWS rows of tiles, of TILE frames at least and of HELD bytes at most: however long a clip
    is, its frames are sent ROWS times, until a tile would be larger than a task should hold.
    """
    sent = packed(frames).select(*clip, F.col("frame_index").cast("long").alias("place"), "pixels")
    # Dealt out by frame, so that frames are worked out once for their number and size and for the tiles.
    sent = sent.repartition(*clip, "place")
    last = sent.groupBy(*clip).agg(F.max("place").alias("_last"), F.max(F.octet_length("pixels")).alias("_size"))
    fitting = F.greatest(F.lit(NARROW), F.least(F.greatest(F.lit(TILE), F.ceil((F.col("_last") + 1) / ROWS)), F.floor(HELD / F.col("_size"))))
    last = last.select(*clip, "_last", (F.lit(tile) if tile else fitting).cast("long").alias("width"))
    at = lambda place: F.floor(place / F.col("width"))
    i = F.col("place")
    far = F.col("_last") if most is None else F.least(F.col("_last"), i + most)
    near = F.lit(0) if most is None else F.greatest(F.lit(0), i - most)
    cell = lambda row, col: F.struct(row.alias("row"), col.alias("col"))
    across = F.transform(F.sequence(at(i), at(far)), lambda col: cell(at(i), col))
    down = F.transform(F.filter(F.sequence(at(near), at(i)), lambda row: row < at(i)), lambda row: cell(row, at(i)))
    placed = sent.join(F.broadcast(last), list(clip)).select(*clip, "place", "pixels", "width", F.explode(F.concat(across, down)).alias("cell"))
    return placed.select(*clip, "place", "pixels", "width", "cell.row", "cell.col")


def _met(places: np.ndarray, blocks: np.ndarray, width: int, row: int, col: int, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places i, places j, similarities) of a tile, some frames by some at a time, with pairs that are not asked for."""
    a, b = np.flatnonzero(places // width == row), np.flatnonzero(places // width == col)
    if not len(a) or not len(b):
        return
    x, y, tile = places[a], places[b], _Tile(blocks[a], blocks[b])
    for i in range(0, len(x), SIDE):
        for j in range(0, len(y), SIDE):
            rows, cols = slice(i, i + SIDE), slice(j, j + SIDE)
            if y[cols][-1] > x[i] and (most is None or y[j] - x[rows][-1] <= most):
                yield x[rows], y[cols], tile.similarity(rows, cols)


def _runs(x: np.ndarray, y: np.ndarray, s: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, first j, number of j, similarities) for each i and each run of neighbouring places j that it meets."""
    low, high = np.searchsorted(y, x, "right"), np.full(len(x), len(y)) if most is None else np.searchsorted(y, x + most, "right")
    cuts = [0, *(np.flatnonzero(np.diff(y) != 1) + 1).tolist(), len(y)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first, n = np.clip(low, a, b), np.clip(high, a, b)
        n = np.maximum(n - first, 0)
        held, place = n > 0, np.arange(a, b)
        if held.any():
            part = s[:, a:b]
            kept = part.ravel() if (n == b - a).all() else part[(place >= first[:, None]) & (place < (first + n)[:, None])]
            yield x[held], y[first[held]], n[held], kept


def pair_similarities(frames: DataFrame, clip: Sequence[str], most: int | None = None, by_lag: bool = False, units: int = 1_000_000, tile: int | None = None) -> DataFrame:
    """frames of ``vectors`` -> clip, i, j, similarity of all pairs i < j at most ``most`` frames apart.

    by_lag: clip, period, n and similarity_sum in whole parts of 1 / units instead, summed in each tile, as
    ``sequences.autocorrelation`` gives them; no pair is written then. A task holds one tile's frames, packed, and writes
    the pairs of SIDE by SIDE frames at a time, a frame's similarities to a run of frames as one array until Spark has them.

    A frame is sent to as many tiles as its clip has rows of them, a number that is the same for clips of any length until
    tiles have their full size; with ``most``, a tile is no wider than that needs.
    """
    tile = tile or (None if most is None else min(TILE, max(NARROW, most)))
    keys = [*clip, "row", "col", "width"]
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    named = ", ".join(f"{c} {kinds[c]}" for c in clip)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("place")
        places, (width, row, col) = table.column("place").to_numpy(), (table.column(c)[0].as_py() for c in ("width", "row", "col"))
        same = {c: table.column(c)[0] for c in clip}
        blocks, lags = _block(table.column("pixels")), {}
        del table
        for x, y, s in _met(places, blocks, width, row, col, most):
            if by_lag:
                apart = y - x[:, None]
                held = (apart > 0) & (apart <= (most if most is not None else 2**62))
                period, whole = apart[held], np.floor(s[held] * units + 0.5)
                if len(period):
                    n, total = np.bincount(period - period.min()), np.bincount(period - period.min(), whole)
                    for d in np.flatnonzero(n).tolist():
                        before = lags.get(d + int(period.min()), (0, 0))
                        lags[d + int(period.min())] = before[0] + int(n[d]), before[1] + int(total[d])
                continue
            for i, first, n, kept in _runs(x, y, s, most):
                likes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(kept))
                columns = {c: pa.repeat(v, len(i)) for c, v in same.items()} | {"i": pa.array(i), "first": pa.array(first), "likes": likes}
                yield pa.RecordBatch.from_pydict(columns)
        if lags:
            columns = {"period": list(lags), "n": [v[0] for v in lags.values()], "similarity_sum": [v[1] for v in lags.values()]}
            yield pa.RecordBatch.from_pydict({c: pa.repeat(v, len(lags)) for c, v in same.items()} | {k: pa.array(v, pa.int64()) for k, v in columns.items()})

    out = f"{named}, period long, n long, similarity_sum long" if by_lag else f"{named}, i long, first long, likes array<double>"
    tiles = _tiles(frames, clip, most, tile)
    if most is None:  # few bytes are much work, so tasks are not joined by their bytes
        tiles = tiles.repartition(SHARES * frames.sparkSession.sparkContext.defaultParallelism, *keys)
    met = tiles.groupBy(*keys).applyInArrow(meet, out)
    if not by_lag:
        each = met.select(*clip, "i", "first", F.posexplode("likes").alias("_at", "similarity"))
        return each.select(*clip, "i", (F.col("first") + F.col("_at")).alias("j"), "similarity")
    n = frames.groupBy(*clip).agg(F.count("*").alias("frames"))
    sums = met.groupBy(*clip, "period").agg(F.sum("similarity_sum").alias("similarity_sum"), F.sum("n").alias("n"))
    return sums.join(n, list(clip)).select(*clip, "frames", "period", "similarity_sum", "n")
