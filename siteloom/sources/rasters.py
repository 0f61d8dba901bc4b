"""A raster on disk in blocks: a folder for each block, so that a window opens only the blocks it meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators.proximity import spread_over

#: Most pixels of one window.
MOST_PIXELS = 4_000_000
SOME_PIXELS = 1 << 18  # of blocks that are cut at once


def write_raster(tiles: DataFrame, path: str, side: int, height: int, width: int, origin: tuple[float, float] = (0.0, 0.0), step: float = 1.0) -> None:
    """Store float32 tiles (ty, tx, data) as blocks below ``path``, with the raster's grid beside them."""
    spark = tiles.sparkSession
    tiles.select("ty", "tx", "data").repartition("ty", "tx").write.mode("overwrite").partitionBy("ty", "tx").parquet(path)
    grid = [(side, height, width, float(origin[0]), float(origin[1]), float(step))]
    spark.createDataFrame(grid, "side int, height long, width long, x0 double, y0 double, step double").coalesce(1).write.mode("overwrite").json(f"{path}/_grid")


def grid_of(spark: SparkSession, path: str) -> dict:
    """side, height, width, x0, y0 and step of a stored raster."""
    return spark.read.schema("side int, height long, width long, x0 double, y0 double, step double").json(f"{path}/_grid").first().asDict()


def same_grid(spark: SparkSession, paths: list[str]) -> dict:
    """The grid that all of ``paths`` share; it is an error if they don't."""
    grids = [grid_of(spark, p) for p in paths]
    for path, grid in zip(paths, grids, strict=True):
        if grid != grids[0]:
            raise ValueError(f"{path} lies on another grid than {paths[0]}")
    return grids[0]


def _clamped(grid: dict, window: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    top, bottom, left, right = window
    top, bottom, left, right = max(0, top), min(grid["height"], bottom), max(0, left), min(grid["width"], right)
    if (bottom - top) * (right - left) > MOST_PIXELS and bottom > top and right > left:
        raise ValueError(f"a window of {(bottom - top) * (right - left)} pixels; {MOST_PIXELS} is the most")
    return top, max(top, bottom), left, max(left, right)


def _pixels(blocks: DataFrame, side: int) -> DataFrame:
    """``blocks`` with row, col and value for each pixel of theirs between top, bottom, left and right."""
    import numpy as np
    import pyarrow as pa

    keys = [c for c in blocks.columns if c not in ("ty", "tx", "data")]

    def cut(batches):
        for whole in batches:
            # Some blocks at a time: their pixels in the order of the block, without those off the window.
            for at in range(0, whole.num_rows, some):
                batch = whole.slice(at, some)
                n = batch.num_rows
                ty, tx, top, bottom, left, right = (batch.column(c).to_numpy()[:, None] for c in ("ty", "tx", "top", "bottom", "left", "right"))
                rows, cols = ty.astype(np.int64) * side + np.arange(side), tx.astype(np.int64) * side + np.arange(side)
                kept = ((rows >= top) & (rows < bottom))[:, :, None] & ((cols >= left) & (cols < right))[:, None, :]
                data = batch.column("data")
                value = np.full((n, side, side), np.nan, np.float32)
                stored = data.is_valid().to_numpy(zero_copy_only=False)
                if stored.any():
                    value[stored] = np.frombuffer(b"".join(data.drop_null().to_pylist()), np.float32).reshape(-1, side, side)
                of, y, x = np.nonzero(kept)
                own = batch.select(keys).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(rows[of, y]), pa.array(cols[of, x]), pa.array(value[kept])], names=[*keys, "row", "col", "value"])

    some = max(1, SOME_PIXELS // side**2)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name in keys)
    return blocks.mapInArrow(cut, f"{fields}, row long, col long, value float")


def read_window(spark: SparkSession, path: str, window: tuple[int, int, int, int]) -> DataFrame:
    """row, col and value of a half-open window (top, bottom, left, right) of pixels, cut to the raster; blocks that are missing are NaN."""
    grid = grid_of(spark, path)
    top, bottom, left, right = _clamped(grid, window)
    side = grid["side"]
    if top == bottom or left == right:
        return spark.createDataFrame([], "row long, col long, value float")
    ys, xs = (top // side, (bottom - 1) // side), (left // side, (right - 1) // side)
    stored = spark.read.schema("data binary, ty int, tx int").parquet(path).where(F.col("ty").between(*ys) & F.col("tx").between(*xs))
    across = xs[1] - xs[0] + 1
    wanted = spark.range((ys[1] - ys[0] + 1) * across).select((F.floor(F.col("id") / across) + ys[0]).cast("int").alias("ty"), (F.pmod("id", F.lit(across)) + xs[0]).cast("int").alias("tx"))
    blocks = wanted.join(stored, ["ty", "tx"], "left").select("ty", "tx", "data", *[F.lit(v).cast("long").alias(n) for n, v in zip(("top", "bottom", "left", "right"), (top, bottom, left, right), strict=True)])
    return _pixels(blocks, side).select("row", "col", "value")


def read_windows(spark: SparkSession, path: str, windows: DataFrame) -> DataFrame:
    """The same for many windows at once (top, bottom, left, right and more columns), a block read once for all of them; a window over ``MOST_PIXELS`` is an error."""
    grid = grid_of(spark, path)
    side = grid["side"]
    cut = windows.withColumns({"top": F.greatest(F.lit(0), F.col("top").cast("long")), "bottom": F.least(F.lit(grid["height"]), F.col("bottom").cast("long")), "left": F.greatest(F.lit(0), F.col("left").cast("long")), "right": F.least(F.lit(grid["width"]), F.col("right").cast("long"))})
    cut = cut.where("top < bottom AND left < right")
    size = (F.col("bottom") - F.col("top")) * (F.col("right") - F.col("left"))
    cut = cut.where(F.when(size > MOST_PIXELS, F.raise_error(F.concat(F.lit("a window of too many pixels: "), size.cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side).cast("int"), F.floor((F.col(b) - 1) / side).cast("int")))
    wanted = cut.withColumn("ty", blocks("top", "bottom")).withColumn("tx", blocks("left", "right"))
    stored = spark.read.schema("data binary, ty int, tx int").parquet(path)
    # Windows are small to read and what they are repeated to is not, so they are dealt over tasks.
    met = wanted.repartition(spread_over(wanted)).join(stored, ["ty", "tx"], "left").select(*windows.columns, "ty", "tx", "data")
    return _pixels(met, side)
