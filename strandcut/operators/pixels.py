"""Kernels on whole line images, run on Arrow batches inside tasks.

A table of lines has ``image_id, dir, h, w, px`` with row-major 8-bit gray
pixels. Each operator is a ``DataFrame -> DataFrame`` step, one image per row,
so an image is all a task ever needs at a time. A line without pixels (null)
stays one, and an empty one stays empty; neither has slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandcut.functions import geometry as G
from strandcut.operators.profiles import KERNEL, LEVELS

WHITE = 255
BLACK = 0
# Pixels of the lines that are worked on together (or one line); a slice set is four times its line.
BLOCK_BYTES = 1 << 20
# Pixels of a line's slices that are given back together, and columns that are smoothed together.
SET_BYTES = 4 * BLOCK_BYTES
STRIP = 1 << 14
Kernel = Callable[[np.ndarray], np.ndarray]


def _levels(values: np.ndarray) -> np.ndarray:
    """Round halves up to whole gray levels."""
    return np.clip(np.floor(values + 0.5), 0, WHITE).astype(np.uint8)


def to_gray(image: np.ndarray) -> np.ndarray:
    """One gray plane from an (h, w, channels) image in blue, green, red order."""
    if image.shape[2] == 1:
        return image[:, :, 0]
    mixed = image[:, :, :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])
    return _levels(mixed)


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned and edges held."""

    def taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    src = image.astype(np.float64)
    if height != image.shape[0]:
        low, high, share = taps(image.shape[0], height)
        src = src[low] * (1 - share)[:, None] + src[high] * share[:, None]
    if width != image.shape[1]:
        low, high, share = taps(image.shape[1], width)
        src = src[:, low] * (1 - share) + src[:, high] * share
    return _levels(src)


def blur(image: np.ndarray, weights: Sequence[float] = KERNEL) -> np.ndarray:
    """Separable smoothing with mirrored borders (the border pixel is not repeated), strip by strip."""
    taps = np.asarray(weights, dtype=np.float64)
    taps = taps / taps.sum()
    half = len(taps) // 2

    def mirror(n: int) -> np.ndarray:
        at = np.mod(np.arange(-half, n + half), max(2 * (n - 1), 1)) if n > 1 else np.zeros(n + 2 * half, dtype=int)
        return np.where(at >= n, 2 * (n - 1) - at, at)

    done = np.empty(image.shape, dtype=np.uint8)
    if not done.size:
        return done
    h, w = image.shape
    rows, columns = mirror(h), mirror(w)
    for x in range(0, w, STRIP):
        n = min(STRIP, w - x)
        wide = image[:, columns[x:x + n + 2 * half]].astype(np.float64)[rows]
        down = sum(t * wide[i:i + h] for i, t in enumerate(taps))
        done[:, x:x + n] = _levels(sum(t * down[:, i:i + n] for i, t in enumerate(taps)))
    return done


def gaussian_taps(sigma: float) -> np.ndarray:
    half = max(1, int(np.ceil(3 * sigma)))
    x = np.arange(-half, half + 1)
    return np.exp(-(x**2) / (2 * sigma * sigma))


def otsu_level(image: np.ndarray) -> int:
    flat = image.ravel()
    counts = [np.bincount(flat[at:at + BLOCK_BYTES], minlength=LEVELS) for at in range(0, len(flat), BLOCK_BYTES)]
    hist = np.sum(counts, axis=0).astype(np.float64) if counts else np.zeros(LEVELS)
    w0, s0 = np.cumsum(hist), np.cumsum(hist * np.arange(LEVELS))
    w, s = w0[-1], s0[-1]
    inner = (w0 > 0) & (w0 < w)
    spread = np.zeros(LEVELS)
    spread[inner] = (s0[inner] * w - s * w0[inner]) ** 2 / (w0[inner] * (w - w0[inner]))
    return int(np.argmax(spread))


def threshold(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu_level(image), np.uint8(WHITE), np.uint8(BLACK))


def ink_bounds(binary: np.ndarray, min_ink: int = G.STRIP_MIN_INK, margin: int = G.STRIP_MARGIN) -> tuple[int, int]:
    """First and last column to keep of a black-and-white line."""
    w = binary.shape[1]
    inked = np.flatnonzero((binary == BLACK).sum(axis=0) > min_ink)
    first, last = (int(inked[0]), int(inked[-1])) if inked.size else (w, w - 1)
    return max(first - margin, 0), min(last + margin, w - 1)


def pad(image: np.ndarray, top: int, bottom: int, left: int, right: int) -> np.ndarray:
    return np.pad(image, ((top, bottom), (left, right)), constant_values=WHITE)


def _pixels(h: int, w: int, px: pa.Buffer) -> np.ndarray:
    return np.frombuffer(px, dtype=np.uint8).reshape(h, w)


def _blocks(batches: Iterator[pa.RecordBatch], pixels: str = "px") -> Iterator[pa.RecordBatch]:
    """Cut batches to ``BLOCK_BYTES``, so that only what Spark sends is held whole, and no copies of it."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(pixels)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def _values(block: pa.RecordBatch, *names: str, pixels: str = "px") -> Iterator[tuple]:
    """Tuples of the columns ``names``, pixels as the buffers that they lie in."""
    return zip(*[
        (v.as_buffer() for v in block.column(n)) if n == pixels else block.column(n).to_pylist() for n in names
    ])


def _images(block: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    """The pictures of a block, None for lines without pixels."""
    return (None if px is None else _pixels(h, w, px) for h, w, px in _values(block, "h", "w", "px"))


def _each(kernel: Callable, *values: Iterable) -> list:
    """What ``kernel`` makes of each picture and the values beside it, None for lines without pixels."""
    return [None if a is None else kernel(a, *more) for a, *more in zip(*values)]


def _made(block: pa.RecordBatch, schema: T.StructType, columns: dict[str, list]) -> pa.RecordBatch:
    """The block with the columns of ``schema``, those of ``columns`` in place of its own."""
    types = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], types.field(n).type) if n in columns else block.column(n) for n in schema.names],
        names=schema.names,
    )


def _plane(block: pa.RecordBatch, done: list[np.ndarray | None]) -> dict[str, list]:
    """Sizes and pixels of the pictures ``done``; a line without pixels keeps the size that it says."""
    sizes = [(h, w) if d is None else d.shape for d, h, w in zip(done, *(block.column(n).to_pylist() for n in "hw"))]
    return {"h": [h for h, _ in sizes], "w": [w for _, w in sizes], "px": _each(np.ndarray.tobytes, done)}


def compose(*kernels: Kernel) -> Kernel:
    """One kernel from several, so that a chain of steps crosses into Python once."""

    def run(a: np.ndarray) -> np.ndarray:
        for kernel in kernels:
            a = kernel(a)
        return a

    return run


def map_images(lines: DataFrame, kernel: Kernel) -> DataFrame:
    """Apply a picture-to-picture kernel to every line, keeping other columns."""
    schema = lines.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _made(block, schema, _plane(block, _each(kernel, _images(block))))

    return lines.mapInArrow(run, schema)


def gray_lines(raw: DataFrame) -> DataFrame:
    """Rows of Spark's image source to gray lines; further columns are kept."""
    schema = T.StructType(
        [f for f in raw.schema if f.name not in ("nChannels", "data")] + [T.StructField("px", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "data"):
            gray = [
                None if d is None else to_gray(np.frombuffer(d, dtype=np.uint8).reshape(h, w, c))
                for h, w, c, d in _values(block, "h", "w", "nChannels", "data", pixels="data")
            ]
            yield _made(block, schema, {"px": _each(np.ndarray.tobytes, gray)})

    return raw.mapInArrow(run, schema)


def to_line_height(a: np.ndarray) -> np.ndarray:
    return resize_bilinear(a, 128 if a.shape[0] > 80 else 64, a.shape[1])


def to_slice_height(a: np.ndarray, height: int = 64) -> np.ndarray:
    """Resizing the line resizes its slices: rows are mixed within a column only."""
    return a if a.shape[0] == height else resize_bilinear(a, height, a.shape[1])


def fit_height(lines: DataFrame) -> DataFrame:
    """Tall lines to 128 rows, others to 64; the width stays."""
    return map_images(lines, to_line_height)


def fit_slice(slices: DataFrame, height: int = 64, width: int = G.SLICE_WIDTH) -> DataFrame:
    """Slices of another height are resized to ``height`` x ``width``."""
    return map_images(slices, lambda a: a if a.shape[0] == height else resize_bilinear(a, height, width))


def smooth(lines: DataFrame) -> DataFrame:
    return map_images(lines, blur)


def random_smooth(lines: DataFrame, seed: int, low: float = 0.1, high: float = 2.0) -> DataFrame:
    """Blur each line by its own repeatable sigma between ``low`` and ``high``."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("image_id"))
    share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    schema = lines.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            sigmas = block.column("__sigma").to_pylist()
            done = _each(lambda a, s: blur(a, gaussian_taps(s)).tobytes(), _images(block), sigmas)
            yield _made(block, schema, {"px": done})

    return lines.withColumn("__sigma", F.lit(low) + share * F.lit(high - low)).mapInArrow(run, schema)


def binarise(lines: DataFrame) -> DataFrame:
    """Black and white by each line's own Otsu level."""
    return map_images(lines, threshold)


def column_ink(lines: DataFrame, out: str = "ink") -> DataFrame:
    """Replace the pixels by the number of black ones in each column."""
    kept = [f for f in lines.schema if f.name != "px"]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _made(block, schema, {out: _each(lambda a: (a == BLACK).sum(axis=0).astype(np.int32), _images(block))})

    return lines.mapInArrow(run, schema)


def pad_sides(lines: DataFrame, columns: int = G.SIDE_PAD) -> DataFrame:
    return map_images(lines, lambda a: pad(a, 0, 0, columns, columns))


def strip_and_pad(lines: DataFrame, height: int = G.SLICE_HEIGHT, multiple: int = G.SLICE_STEP) -> DataFrame:
    """Cut blank ends, then pad to ``height`` rows and a width in steps of ``multiple``.

    The blank ends are found on the smoothed black-and-white line; what is kept
    is gray. Adds ``crop_beg`` and ``crop_end``. Lines must be lower than ``height``.
    """
    schema = T.StructType(
        [*lines.schema, T.StructField("crop_beg", T.IntegerType()), T.StructField("crop_end", T.IntegerType())]
    )

    def one(a: np.ndarray) -> tuple[np.ndarray, int, int]:
        beg, end = ink_bounds(threshold(blur(a)))
        kept = a[:, beg:end + 1]
        rows, cols = height - kept.shape[0], -kept.shape[1] % multiple
        return pad(kept, rows // 2, rows - rows // 2, cols // 2, cols - cols // 2), beg, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            done, beg, end = zip(*[d or (None, None, None) for d in _each(one, _images(block))])
            yield _made(block, schema, {**_plane(block, done), "crop_beg": beg, "crop_end": end})

    return lines.mapInArrow(run, schema)


def crop_and_pad(lines: DataFrame, height: int = G.SLICE_HEIGHT) -> DataFrame:
    """Bring every line to ``height`` rows: cut evenly above and below, or pad."""

    def one(a: np.ndarray) -> np.ndarray:
        extra = max(a.shape[0] - height, 0)
        a = a[extra // 2:a.shape[0] - (extra - extra // 2)]
        rows = height - a.shape[0]
        return pad(a, rows // 2, rows - rows // 2, 0, 0)

    return map_images(lines, one)


def slice_pixels(
    lines: DataFrame, *, size: int = G.SLICE_WIDTH, step: int = G.SLICE_STEP
) -> DataFrame:
    """One row per slice with its pixels, made where the line is, without a join."""
    keep = [f for f in lines.schema if f.name not in ("h", "w", "px")]
    schema = T.StructType(
        keep
        + [
            T.StructField("slice_no", T.IntegerType()),
            T.StructField("beg", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("h", T.IntegerType()),
            T.StructField("w", T.IntegerType()),
            T.StructField("px", T.BinaryType()),
        ]
    )

    def cut(a: np.ndarray | None) -> np.ndarray:
        """Views of all slices of a picture, (n, h, size)."""
        if a is None or a.shape[1] < size:
            return np.empty((0, 0 if a is None else a.shape[0], size), dtype=np.uint8)
        return np.lib.stride_tricks.sliding_window_view(a, size, axis=1)[:, ::step].transpose(1, 0, 2)

    def runs(sets: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        """The first numbers and the slices of each run: all of a block, or ``SET_BYTES`` of a line beyond them."""
        most = [max(1, SET_BYTES // max(1, s.shape[1] * size)) for s in sets]
        for k in range(max(1, *(-(-len(s) // m) for s, m in zip(sets, most)))):
            yield [k * m for m in most], [np.ascontiguousarray(s[k * m:(k + 1) * m]) for s, m in zip(sets, most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            lines_of = block.select([f.name for f in keep])
            for firsts, cuts in runs([cut(a) for a in _images(block)]):
                counts = [len(c) for c in cuts]
                numbers = np.concatenate([f + np.arange(n) for f, n in zip(firsts, counts)]).astype(np.int32)
                made = lines_of.take(pa.array(np.repeat(np.arange(len(cuts)), counts), pa.int64()))
                yield _made(made, schema, {
                    "slice_no": numbers,
                    "beg": numbers * step,
                    "end": numbers * step + (size - 1),
                    "h": np.repeat([c.shape[1] for c in cuts], counts),
                    "w": np.full(len(numbers), size, dtype=np.int32),
                    "px": [one.tobytes() for c in cuts for one in c],
                })

    return lines.mapInArrow(run, schema)


def mark_centre(slices: DataFrame) -> DataFrame:
    """Blacken the middle column of each slice."""

    def one(a: np.ndarray) -> np.ndarray:
        a = a.copy()
        middle = a.shape[1] // 2
        a[:, middle:middle + 1] = BLACK
        return a

    return map_images(slices, one)


def draw_cuts(lines: DataFrame, cuts: DataFrame, key: str = "image_id", x: str = "x") -> DataFrame:
    """Blacken each line's cut columns.

    Cuts are made distinct per line, so a line takes at most as many as it is
    wide; lines without a cut stay as they are.
    """
    per_line = cuts.groupBy(key).agg(F.collect_set(F.col(x).cast("int")).alias("__xs"))
    joined = lines.join(per_line, key, "left").select(*lines.columns, "__xs")
    schema = lines.schema

    def one(a: np.ndarray, xs: list[int] | None) -> bytes:
        a = a.copy()
        if xs is not None:
            a[:, [v for v in xs if 0 <= v < a.shape[1]]] = BLACK
        return a.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _made(block, schema, {"px": _each(one, _images(block), block.column("__xs").to_pylist())})

    return joined.mapInArrow(run, schema)


def to_floats(slices: DataFrame, out: str = "pixels") -> DataFrame:
    """Replace the bytes by an array of floats, the form models read."""

    @F.pandas_udf("array<float>")
    def cast(px: pd.Series) -> pd.Series:
        return px.map(lambda b: np.frombuffer(b, dtype=np.uint8).astype(np.float32))

    return slices.withColumn(out, cast("px")).drop("px")
