"""Cutting a survey into tiles: buffers, subdivision of dense tiles, merging of sparse ones, batches."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import Tiles
from ..session import broadcast_if_small, materialise

MOST_LEVELS = 4
#: No merged tile spans more base tiles than this on a side.
MOST_SPAN = 8


def with_tiles(points: DataFrame, tiles: Tiles, buffer: float = 0.0) -> DataFrame:
    """points with tile_col, tile_row, is_core; a point goes to every tile whose core, widened by
    buffer, holds it, so it is the core of one tile and the buffer of any number, whatever buffer / size."""
    x, y = F.col("x"), F.col("y")
    if buffer <= 0:
        return points.select("*", tiles.col(x).alias("tile_col"), tiles.row(y).alias("tile_row"), F.lit(True).alias("is_core"))
    spans = [F.sequence(f(v - buffer), f(v + buffer)) for f, v in ((tiles.col, x), (tiles.row, y))]
    rows = points.select("*", tiles.col(x).alias("__c"), tiles.row(y).alias("__r"), spans[1].alias("__rows"), F.explode(spans[0]).alias("tile_col"))
    rows = rows.select("*", F.explode("__rows").alias("tile_row"))
    core = (F.col("tile_col") == F.col("__c")) & (F.col("tile_row") == F.col("__r"))
    return rows.select(*points.columns, "tile_col", "tile_row", core.alias("is_core"))


def core_only(tiled: DataFrame) -> DataFrame:
    return tiled.where("is_core").drop("is_core")


def tile_counts(points: DataFrame, tiles: Tiles, buffer: float = 0.0) -> DataFrame:
    """tile_col, tile_row, point_count (core), buffered_count and the core's bounds, one pass."""
    core = F.col("is_core")
    own = [f(F.when(core, F.col(c))).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return with_tiles(points, tiles, buffer).groupBy("tile_col", "tile_row").agg(F.count(F.when(core, 1)).alias("point_count"), F.count(F.lit(1)).alias("buffered_count"), *own)


def subdivision_levels(points: DataFrame, tiles: Tiles, cap: int) -> DataFrame:
    """tile_col, tile_row, level: the least level at which every 2^level-th part has 0.9 cap points at most.

    Counts at the finest level are summed upwards, so the points are read once.
    """
    levels = MOST_LEVELS
    while levels > 1 and tiles.cols * tiles.rows * 4**levels > 32_000_000:
        levels -= 1
    limit, fine = max(int(0.9 * cap), 1), 2**levels

    def part(v, low: float, tile):
        inside = (v - (low + tile * tiles.size)) * fine / tiles.size
        return F.least(F.greatest(F.floor(inside), F.lit(0)), F.lit(fine - 1)).cast("long")

    c, r = tiles.col(F.col("x")), tiles.row(F.col("y"))
    cells = points.select(c.alias("tile_col"), r.alias("tile_row"), part(F.col("x"), tiles.x_min, c).alias("sc"), part(F.col("y"), tiles.y_min, r).alias("sr"))
    fine_counts = cells.groupBy("tile_col", "tile_row", "sc", "sr").agg(F.count(F.lit(1)).alias("n"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    up = fine_counts.select("tile_col", "tile_row", "n", "sc", "sr", steps)
    shift = F.pow(F.lit(2), F.lit(levels) - F.col("level")).cast("long")
    up = up.groupBy("tile_col", "tile_row", "level", F.floor(F.col("sc") / shift).alias("a"), F.floor(F.col("sr") / shift).alias("b")).agg(F.sum("n").alias("n"))
    most = up.groupBy("tile_col", "tile_row", "level").agg(F.max("n").alias("most"))
    fits = F.min(F.when(F.col("most") <= limit, F.col("level")))
    return most.groupBy("tile_col", "tile_row").agg(F.coalesce(fits, F.lit(levels)).cast("int").alias("level"))


def with_subtiles(points: DataFrame, tiles: Tiles, levels: DataFrame) -> DataFrame:
    """points with tile_col, tile_row, level, sub_col, sub_row; a point lies in the sub-tile whose core holds it."""
    c, r = tiles.col(F.col("x")), tiles.row(F.col("y"))
    rows = points.select("*", c.alias("tile_col"), r.alias("tile_row")).join(broadcast_if_small(levels, 1_000_000), ["tile_col", "tile_row"])
    n = F.pow(F.lit(2), F.col("level")).cast("long")

    def part(v, low: float, tile):
        return F.least(F.greatest(F.floor((v - (low + tile * tiles.size)) * n / tiles.size), F.lit(0)), n - 1).cast("long")

    return rows.select(*points.columns, "tile_col", "tile_row", "level", part(F.col("x"), tiles.x_min, F.col("tile_col")).alias("sub_col"), part(F.col("y"), tiles.y_min, F.col("tile_row")).alias("sub_row"))


def merged_spans(counts: DataFrame, floor: int, most_span: int = MOST_SPAN) -> DataFrame:
    """tile_col, tile_row, span: of tiles (tile_col, tile_row, n, locked) the side, in tiles, of the merged tile that each becomes.

    The same plan as ``merge_sparse`` as a table, for any number of tiles: an aligned block becomes one tile if its points
    are floor at most and none of its tiles is locked; then so do the blocks within it.
    """
    rows, span, spans = counts, 2, F.lit(1)
    while span <= most_span:
        block = Window.partitionBy(F.floor(F.col("tile_col") / span), F.floor(F.col("tile_row") / span))
        rows = rows.withColumns({f"__n{span}": F.sum("n").over(block), f"__l{span}": F.max("locked").over(block)})
        spans = F.when((F.col(f"__n{span}") <= floor) & ~F.col(f"__l{span}"), F.lit(span)).otherwise(spans)
        span *= 2
    return rows.select("tile_col", "tile_row", spans.alias("span"))


def with_adaptive_tiles(points: DataFrame, tiles: Tiles, buffer: float = 0.0, cap: int = 0, floor: int = 0) -> DataFrame:
    """As with_tiles, but tiles of more than cap points are subdivided and blocks of sparse ones merged, buffers included.

    So no tile holds much more than cap points, and operators that work tile by tile are bounded. tile_col and tile_row count
    the finest parts, 2^MOST_LEVELS to a side of a plain tile, from the survey's corner: those of a tile's least part.
    """
    fine = 1 << MOST_LEVELS
    own = points.select(tiles.col(F.col("x")).alias("tile_col"), tiles.row(F.col("y")).alias("tile_row"))
    counts = own.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("n"))
    levels = subdivision_levels(points, tiles, cap) if cap else counts.select("tile_col", "tile_row", F.lit(0).alias("level"))
    plan = counts.join(levels, ["tile_col", "tile_row"])
    if floor:
        plan = plan.join(merged_spans(plan.select("tile_col", "tile_row", "n", (F.col("level") > 0).alias("locked")), floor), ["tile_col", "tile_row"])
    else:
        plan = plan.withColumn("span", F.lit(1))
    plan = materialise(plan.select(F.col("tile_col").alias("__c"), F.col("tile_row").alias("__r"), F.col("level").alias("__level"), F.col("span").alias("__span")), "tiles")
    x, y = F.col("x"), F.col("y")
    rows = with_tiles(points, tiles, buffer).withColumnsRenamed({"tile_col": "__c", "tile_row": "__r", "is_core": "__core"})
    rows = rows.join(broadcast_if_small(plan, 1_000_000), ["__c", "__r"])
    # Of the base tiles of a merged tile, the one nearest to the point's own stands for all.
    for c, mine in (("__c", tiles.col(x)), ("__r", tiles.row(y))):
        least = F.floor(F.col(c) / F.col("__span")) * F.col("__span")
        rows = rows.withColumn(f"{c}0", least).where(F.col(c) == F.least(F.greatest(mine, least), least + F.col("__span") - 1))
    n = F.pow(F.lit(2), F.col("__level")).cast("int")

    def parts(v: Column, low: float, tile: str, by: float) -> Column:
        return F.least(F.greatest(F.floor((v + by - (low + F.col(tile) * tiles.size)) * n / tiles.size), F.lit(0)), n - 1).cast("long")

    for v, low, c in ((x, tiles.x_min, "__c"), (y, tiles.y_min, "__r")):
        rows = rows.select("*", parts(v, low, c, 0.0).alias(f"{c}own"), F.explode(F.sequence(parts(v, low, c, -buffer), parts(v, low, c, buffer))).alias(f"{c}part"))
    core = F.col("__core") & (F.col("__cown") == F.col("__cpart")) & (F.col("__rown") == F.col("__rpart"))
    at = [(F.col(f"{c}0") * fine + F.col(f"{c}part") * (F.lit(fine) / n)).cast("long").alias(name) for c, name in (("__c", "tile_col"), ("__r", "tile_row"))]
    return rows.select(*points.columns, *at, core.alias("is_core"))


@dataclass(frozen=True)
class MergedTile:
    col: int
    row: int
    span: int
    members: tuple[tuple[int, int], ...]
    count: int


def merge_sparse(counts: dict[tuple[int, int], int], floor: int, locked: frozenset[tuple[int, int]] = frozenset(), most_span: int = MOST_SPAN) -> list[MergedTile]:
    """Aligned 2 x 2 blocks become one tile while their points are floor at most, bottom-up.

    A block with a locked member (a subdivided tile), or one that stays apart, keeps its ancestors apart too. Tiles
    without points don't exist. counts has one entry for each tile that has points: a driver-side plan.
    """
    done: list[MergedTile] = []
    live = {k: (1, (k,), n) for k, n in counts.items() if n > 0}
    closed = {k for k in locked if k in live}
    span = 1
    while span < most_span and any(k not in closed for k in live):
        blocks: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for k in live:
            blocks[k[0] // 2, k[1] // 2].append(k)
        above, shut = {}, set()
        for block, kids in blocks.items():
            total = sum(live[k][2] for k in kids)
            if total <= floor and not any(k in closed for k in kids):
                above[block] = (span * 2, tuple(sorted(m for k in kids for m in live[k][1])), total)
                continue
            done += [_finished(k, live[k]) for k in kids if live[k][1]]
            above[block] = (span * 2, (), 0)
            shut.add(block)
        live, closed, span = above, shut, span * 2
    done += [_finished(k, v) for k, v in live.items() if v[1]]
    return sorted(done, key=lambda t: (t.row, t.col))


def _finished(key: tuple[int, int], value: tuple[int, tuple, int]) -> MergedTile:
    span, members, n = value
    return MergedTile(key[0] * span, key[1] * span, span, members, n)


def batches(counts: list[tuple], cap: int) -> list[list]:
    """Tiles (key..., count), sorted by key, cut greedily into runs of cap points; a larger tile is a run alone."""
    runs: list[list] = []
    room = -1
    for *key, n in sorted(counts):
        if room < n or not runs:
            runs.append([])
            room = cap
        runs[-1].append(tuple(key))
        room -= n
    return runs


def suggested_floor(total: int) -> int:
    """Of points, below which tiles are worth merging."""
    return min(max(total // 3000, 50_000), 2_000_000)


def tile_id(col: int, row: int, level: int = 0, sub_row: int = 0, sub_col: int = 0, span: int = 1) -> str:
    name = f"c{col:04d}_r{row:04d}"
    if level:
        name += f"_s{level}_{sub_row:02d}_{sub_col:02d}"
    return name + (f"_x{span}" if span > 1 else "")


@dataclass(frozen=True)
class Preflight:
    tiles: int
    per_tile: int
    peak_bytes: int
    mosaic_bytes: int
    fits: bool
    segment_points: int | None


def preflight(points: int, area: float, tile_size: float, workers: int, budget_bytes: int, factor: float = 1.0) -> Preflight:
    """What a run will need: 64 bytes a point and worker, three rasters of 1 m cells in 4 bytes."""
    n = max(1, math.ceil(area / tile_size**2))
    per_tile = math.ceil(points / n)
    peak, mosaic = int(workers * per_tile * 64 * factor), int(area * 12)
    fits = max(peak, mosaic) < 0.7 * budget_bytes
    segment = None
    if area > 0 and mosaic >= 0.7 * budget_bytes:
        cap = int(0.5 * budget_bytes / 12 * points / area)
        segment = cap if cap and 2 <= math.ceil(points / cap) <= 200 else None
    return Preflight(n, per_tile, peak, mosaic, fits, segment)
