"""Pixel and plane features.

A plane is one record: keys, ``height``, ``width`` and a row-major array. Neighbourhood chains run on whole planes
inside a task; statistics come from exploding planes next to their source, so that partial aggregation shrinks them
to cells before any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfare.functions import kernels
from gridfare.functions.columns import bound, col, count_if, ratio, total
from gridfare.functions.ranking import exact_quantiles
from gridfare.schemas import CELL_HEIGHT, CELL_WIDTH

BINS = 32
LEVELS = 32
# Luma weights and the grass hue band.
GRAY_WEIGHTS = (0.299, 0.587, 0.114)
GRASS_HUE = (0.15, 0.45)
# Neighbour steps (dy, dx) at distance 1 for 0, 45, 90 and 135 degrees.
ANGLES = [(0, 1), (1, 1), (1, 0), (1, -1)]

# ---- pixels and colour ----


def image_planes(images: DataFrame) -> DataFrame:
    """Decoded images (Spark's ``image`` source) to channel planes ``b``, ``g``, ``r``; undecodable files drop out."""
    good = images.where("image.height > 0")
    planes = good.select(
        F.element_at(F.split("image.origin", "/"), -1).alias("image"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        kernels.decode_udf()("image.data", "image.nChannels").alias("p"),
    )
    return planes.select("image", "height", "width", "p.b", "p.g", "p.r")


def explode_pixels(planes: DataFrame, channels: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """One row per pixel with ``y``, ``x`` and its channel values."""
    kept = [c for c in planes.columns if c not in (*channels, "height")]
    rows = planes.select(*kept, F.posexplode(F.arrays_zip(*channels)).alias("_i", "_p"))
    place = {"y": F.floor(F.col("_i") / F.col("width")), "x": F.col("_i") % F.col("width")}
    plain = [c for c in kept if c != "width"]
    return rows.select(
        *plain,
        *[e.cast("long").alias(n) for n, e in place.items()],
        *[F.col(f"_p.{c}").alias(c) for c in channels],
    )


def assign_cell(pixels: DataFrame, *, cell_height: int = CELL_HEIGHT, cell_width: int = CELL_WIDTH) -> DataFrame:
    """The grid cell a pixel lies in."""
    return pixels.withColumns(
        {
            "cell_row": F.floor(F.col("y") / cell_height).cast("long"),
            "cell_col": F.floor(F.col("x") / cell_width).cast("long"),
        }
    )


def to_gray(pixels: DataFrame, *, weights: Sequence[float] = GRAY_WEIGHTS) -> DataFrame:
    """Luma in 0-1 and the truncated 0-255 level."""
    r, g, b = weights
    luma = (r * F.col("r") + g * F.col("g") + b * F.col("b")) / 255
    return pixels.withColumns({"gray": luma, "gray_level": F.floor(F.round(luma * 255, 9)).cast("long")})


def to_hsv(pixels: DataFrame) -> DataFrame:
    """Hue, saturation and value in 0-1 from 0-255 channels."""
    r, g, b = (F.col(c) / 255 for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = top - low
    sector = F.when(b == top, 4 + (r - g) / spread).when(g == top, 2 + (b - r) / spread).otherwise((g - b) / spread)
    return pixels.withColumns(
        {
            "h": F.when(spread == 0, 0.0).otherwise(F.pmod(sector / 6, F.lit(1.0))),
            "s": F.when(top == 0, 0.0).otherwise(spread / top),
            "v": top,
        }
    )


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Histogram bin with a closed last edge; values outside the range have none."""
    place = F.least(F.floor((value - low) * bins / (high - low)), F.lit(bins - 1))
    return F.when(value.between(low, high), place)


def colour_histogram(pixels: DataFrame, keys: Sequence[str], *, bins: int = BINS) -> DataFrame:
    """Raw counts of 32 bins for R, G, B, H, S, V, as ``f000``.. in that order."""
    ranges = [("r", 0, 256), ("g", 0, 256), ("b", 0, 256), ("h", 0, 1), ("s", 0, 1), ("v", 0, 1)]
    codes = [(_bin(F.col(c), lo, hi, bins) + i * bins).cast("int") for i, (c, lo, hi) in enumerate(ranges)]
    rows = to_hsv(pixels).select(*keys, F.explode(F.array(*codes)).alias("code"))
    counts = rows.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy(*keys).pivot("code", list(range(6 * bins))).agg(F.first("n"))
    named = [F.coalesce(F.col(str(i)), F.lit(0)).alias(f"f{i:03d}") for i in range(6 * bins)]
    return wide.select(*keys, *named)


def colour_moments(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, deviation and skew of hue, saturation and value."""
    aggs = []
    for c in "hsv":
        skew = F.skewness(c)
        flat = F.stddev_pop(c) == 0
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_pop(c).alias(f"{c}_std"),
            F.when(flat | skew.isNull() | F.isnan(skew), 0.0).otherwise(skew).alias(f"{c}_skew"),
        ]
    return to_hsv(pixels).groupBy(*keys).agg(*aggs)


def dominant_colour(
    pixels: DataFrame,
    *,
    patch: Sequence[str] = ("image", "cell_row", "cell_col"),
    label: str = "label",
    patches: int | None = None,
    grass: tuple[float, float] = GRASS_HUE,
) -> DataFrame:
    """Mean colour of the patches of each team without their grass-coloured pixels.

    ``patches`` takes a stable sample of so many patches a team; Spark applies it before the shuffle as well as after.
    """
    own = pixels.where(F.col(label) > 0)
    if patches is not None:
        order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws("|", *patch)), *patch)
        found = own.select(label, *patch).distinct().withColumn("_n", F.row_number().over(order))
        own = own.join(found.where(F.col("_n") <= patches).drop("_n"), [label, *patch], "left_semi")
    kept = to_hsv(own)
    kept = kept.where(~F.col("h").between(*grass))
    return kept.groupBy(label).agg(F.count(F.lit(1)).alias("pixels"), *[F.avg(c).alias(f"mean_{c}") for c in "rgbhsv"])


def colour_shift_profile(
    df: DataFrame, group: str, channels: Sequence[str]
) -> DataFrame:
    """Spread of each channel within each lighting group: deviation and the middle half."""
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in channels])
    long = long.unpivot([group], list(channels), "channel", "level")
    keys = [group, "channel"]
    spread = long.groupBy(*keys).agg(F.stddev_pop("level").alias("std"), F.avg("level").alias("mean"))
    ends = exact_quantiles(long, keys, "level", {"q25": 0.25, "q75": 0.75})
    return spread.join(ends, keys).withColumn("iqr", F.col("q75") - F.col("q25"))


# ---- cutting planes ----


def cut_cells(
    planes: DataFrame, values: str, *, cell_height: int = CELL_HEIGHT, cell_width: int = CELL_WIDTH
) -> DataFrame:
    """One small plane per grid cell; whole cells only."""
    down = F.sequence(F.lit(0), F.floor(F.col("height") / cell_height).cast("int") - 1)
    across = F.sequence(F.lit(0), F.floor(F.col("width") / cell_width).cast("int") - 1)
    lines = F.sequence(F.lit(0), F.lit(cell_height - 1))

    def crop(r: Column, c: Column) -> Column:
        start = lambda y: ((r * cell_height + y) * F.col("width") + c * cell_width + 1).cast("int")
        rows = F.transform(lines, lambda y: F.slice(values, start(y), cell_width))
        return F.struct(r.alias("cell_row"), c.alias("cell_col"), F.flatten(rows).alias("cell"))

    crops = F.flatten(F.transform(down, lambda r: F.transform(across, lambda c: crop(r, c))))
    keys = [c for c in planes.columns if c not in (values, "height", "width")]
    cut = planes.select(*keys, F.inline(crops))
    return cut.select(
        *keys,
        F.col("cell_row").cast("long").alias("cell_row"),
        F.col("cell_col").cast("long").alias("cell_col"),
        F.lit(cell_height).alias("height"),
        F.lit(cell_width).alias("width"),
        F.col("cell").alias(values),
    )


def _with_neighbours(planes: DataFrame, keys: Sequence[str], values: str, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """Pixel rows carrying the pixels at each step as ``n0``..; null outside the plane.

    Shifted copies of the array are zipped and exploded together: no self join, no window, no lambda per pixel.
    """
    size, width = F.size(values), F.col("width")
    zipped = [F.col(values).alias("c")]
    for i, (dy, dx) in enumerate(steps):
        by = (width * dy + dx).cast("int")
        ahead = F.slice(values, F.greatest(by, F.lit(0)) + 1, size)
        lead = F.array_repeat(F.lit(None).cast("double"), F.greatest(-by, F.lit(0)))
        zipped.append(F.concat(lead, ahead.cast("array<double>")).alias(f"n{i}"))
    named = planes.select(*keys, "height", "width", *zipped)
    names = ["c", *[f"n{i}" for i in range(len(steps))]]
    rows = named.select(*keys, "height", "width", F.posexplode(F.arrays_zip(*names)).alias("_i", "_p"))
    y, x = F.floor(F.col("_i") / F.col("width")), F.col("_i") % F.col("width")
    # A leading shift makes the zipped array longer than the plane; those rows are no pixels.
    real = rows.where(F.col("_i") < F.col("height") * F.col("width"))
    found = []
    for i, (dy, dx) in enumerate(steps):
        inside = (y + dy).between(0, F.col("height") - 1) & (x + dx).between(0, F.col("width") - 1)
        found.append(F.when(inside, F.col(f"_p.n{i}")).alias(f"n{i}"))
    return real.select(
        *keys, "height", "width", y.cast("long").alias("y"), x.cast("long").alias("x"), F.col("_p.c").alias("c"), *found
    )


# ---- texture ----


def lbp_histogram(cells: DataFrame, keys: Sequence[str], *, values: str = "level") -> DataFrame:
    """Shares of the ten uniform rotation-invariant binary patterns at radius 1, ``tex_00``..``tex_09``.

    A neighbour outside the cell counts as 0. Diagonal neighbours are the pixels themselves, not interpolated.
    """
    ring = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
    rows = _with_neighbours(cells, keys, values, ring)
    bits = [F.when(F.coalesce(F.col(f"n{i}"), F.lit(0.0)) >= F.col("c"), 1).otherwise(0) for i in range(8)]
    coded = rows.select(*keys, *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    ones = total([F.col(f"b{i}") for i in range(8)])
    changes = total([F.abs(F.col(f"b{i}") - F.col(f"b{(i + 1) % 8}")) for i in range(8)])
    code = F.when(changes <= 2, ones).otherwise(9)
    hits = coded.select(*keys, code.alias("code")).groupBy(*keys)
    shares = [(count_if(F.col("code") == k) / (F.count(F.lit(1)) + 1e-6)).alias(f"tex_{k:02d}") for k in range(10)]
    return hits.agg(*shares)


def glcm_features(cells: DataFrame, keys: Sequence[str], *, values: str = "level", levels: int = LEVELS) -> DataFrame:
    """Contrast, homogeneity, energy and correlation at four angles, ``tex_10``..``tex_25``.

    Pairs are counted with both orders, so the matrix is symmetric.
    """
    step = 256 // levels
    rows = _with_neighbours(cells, keys, values, ANGLES)
    here = F.floor(F.col("c") / step)
    # Angle and both levels, the lower first, travel as one number; a pair that leaves the cell has none.
    codes = []
    for a in range(len(ANGLES)):
        there = F.floor(F.col(f"n{a}") / step)
        ordered = F.least(here, there) * levels + F.greatest(here, there)
        codes.append(F.when(there.isNotNull(), a * levels * levels + ordered).cast("int"))
    one_way = rows.select(*keys, F.explode(F.array(*codes)).alias("code")).where("code is not null")
    counts = one_way.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n")).select(
        *keys,
        F.floor(F.col("code") / (levels * levels)).alias("angle"),
        (F.floor(F.col("code") / levels) % levels).alias("i"),
        (F.col("code") % levels).cast("long").alias("j"),
        "n",
    )
    # A pair stands for two entries of the symmetric matrix, or for one of twice its count on the diagonal.
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    gap = i - j
    sums = counts.groupBy(*keys, "angle").agg(
        F.sum(2 * n).alias("t"),
        F.sum(2 * n * gap * gap).alias("contrast"),
        F.sum(2 * n / (1 + gap * gap)).alias("homogeneity"),
        F.sum(F.when(i == j, 4 * n * n).otherwise(2 * n * n)).alias("asm"),
        F.sum(n * (i + j)).alias("si"),
        F.sum(n * (i * i + j * j)).alias("sii"),
        F.sum(2 * n * i * j).alias("sij"),
    )
    t = F.col("t")
    # Symmetric counts: both margins share mean and variance. Integers keep the variance test exact.
    variance = F.col("sii") * t - F.col("si") * F.col("si")
    covariance = F.col("sij") * t - F.col("si") * F.col("si")
    props = [
        F.col("contrast") / t,
        F.col("homogeneity") / t,
        F.sqrt(F.col("asm")) / t,
        F.when(variance == 0, 1.0).otherwise(covariance / variance),
    ]
    long = sums.select(*keys, "angle", *[p.alias(f"p{k}") for k, p in enumerate(props)])
    wide = [
        F.max(F.when(F.col("angle") == a, F.col(f"p{k}"))).alias(f"tex_{10 + 4 * k + a:02d}")
        for k in range(4)
        for a in range(4)
    ]
    return long.groupBy(*keys).agg(*wide)


# ---- edges ----


def _apply(planes: DataFrame, values: str, kernel, into: str, element: str = "double") -> DataFrame:
    run = kernels.plane_udf(kernel, element)
    return planes.withColumn(into, run(F.col(values), F.col("height"), F.col("width")))


def gaussian_blur(planes: DataFrame, *, values: str = "level", into: str = "blurred") -> DataFrame:
    """5x5 binomial blur with reflect-101 borders."""
    return _apply(planes, values, kernels.blur, into)


def edge_maps(
    planes: DataFrame, *, values: str = "level", low: float = 50, high: float = 150, smooth: bool = True,
    cell: tuple[int, int] | None = None,
) -> DataFrame:
    """``gx``, ``gy``, ``laplacian`` and ``edge`` planes of the (blurred) input, computed once per image.

    With the height and width of a ``cell``, ``contour`` marks each outer contour of a cell at one of its pixels.
    """
    run = kernels.edge_maps_udf(low, high, smooth, cell)
    maps = planes.withColumn("_m", run(F.col(values), F.col("height"), F.col("width")))
    return maps.select(*planes.columns, "_m.*")


def magnitude(gx: Column, gy: Column) -> Column:
    return F.sqrt(gx * gx + gy * gy)


def orientation(gx: Column, gy: Column) -> Column:
    """Gradient direction in degrees, folded to 0-180."""
    folded = F.pmod(F.degrees(F.atan2(gy, gx)), F.lit(180.0))
    return folded


def sobel(planes: DataFrame, keys: Sequence[str], *, values: str = "level", smooth: bool = False) -> DataFrame:
    """Pixel rows with ``gx``, ``gy``, magnitude and folded angle."""
    maps = edge_maps(planes, values=values, smooth=smooth).select(*keys, "height", "width", "gx", "gy")
    rows = explode_pixels(maps, ["gx", "gy"])
    gx, gy = F.col("gx"), F.col("gy")
    return rows.withColumns({"magnitude": magnitude(gx, gy), "angle": orientation(gx, gy)})


def laplacian(planes: DataFrame, *, values: str = "level", into: str = "laplacian") -> DataFrame:
    """Second derivative over the four direct neighbours."""
    return _apply(planes, values, kernels.laplacian, into)


def edge_map(
    planes: DataFrame, *, values: str = "level", low: float = 50, high: float = 150, smooth: bool = True
) -> DataFrame:
    """Thin edges: gradient ridges above ``low`` connected to one above ``high``."""
    maps = edge_maps(planes, values=values, low=low, high=high, smooth=smooth)
    return maps.select(*planes.columns, "edge")


def edge_cell_stats(
    maps: DataFrame, keys: Sequence[str], *, cell_height: int = CELL_HEIGHT, cell_width: int = CELL_WIDTH
) -> DataFrame:
    """Edge density and count, Sobel mean and deviation, Laplacian variance per cell."""
    rows = explode_pixels(maps.select(*keys, "height", "width", "edge", "gx", "gy", "laplacian"),
                          ["edge", "gx", "gy", "laplacian"])
    placed = assign_cell(rows, cell_height=cell_height, cell_width=cell_width)
    return placed.groupBy(*keys, "cell_row", "cell_col").agg(*_edge_figures())


def _edge_figures() -> list[Column]:
    strength = magnitude(F.col("gx"), F.col("gy"))
    return [
        (F.sum("edge") / F.count(F.lit(1))).alias("f_edge_density"),
        F.sum("edge").alias("f_canny_count"),
        F.avg(strength).alias("f_sobel_mean"),
        F.stddev_pop(strength).alias("f_sobel_std"),
        F.var_pop("laplacian").alias("f_laplacian_var"),
    ]


def edge_table(
    planes: DataFrame,
    keys: Sequence[str],
    *,
    values: str = "level",
    cell_height: int = CELL_HEIGHT,
    cell_width: int = CELL_WIDTH,
    low: float = 50,
    high: float = 150,
    smooth: bool = True,
) -> DataFrame:
    """All 42 edge columns of each cell: edge statistics, outer contours and 36 gradient shares.

    One Arrow pass gives all maps of a plane, one explosion its pixels, and one aggregate, which combines before the
    shuffle, every figure.
    """
    maps = edge_maps(planes, values=values, low=low, high=high, smooth=smooth, cell=(cell_height, cell_width))
    names = ["edge", "gx", "gy", "laplacian", "contour"]
    placed = assign_cell(explode_pixels(maps.select(*keys, "height", "width", *names), names), cell_height=cell_height, cell_width=cell_width)
    sums, shares = _gradient_shares(cell_height, cell_width, 2, 9)
    cell = [*keys, "cell_row", "cell_col"]
    contours = F.sum("contour").alias("f_contour_count")
    figures = placed.groupBy(*cell).agg(*_edge_figures(), contours, *sums)
    return figures.select(*[c for c in figures.columns if not c.startswith("_h")], *shares)


def external_contour_count(
    maps: DataFrame, keys: Sequence[str], *, cell_height: int = CELL_HEIGHT, cell_width: int = CELL_WIDTH
) -> DataFrame:
    """Outer contours of the edge map cropped to each cell."""
    crops = cut_cells(
        maps.select(*keys, "height", "width", "edge"), "edge", cell_height=cell_height, cell_width=cell_width
    )
    marked = _apply(crops, "edge", _outer_labels, "_o", "bigint")
    outer = F.size(F.array_distinct(F.filter("_o", lambda label: label > 0)))
    return marked.select(*keys, "cell_row", "cell_col", outer.cast("long").alias("f_contour_count"))


def _outer_labels(m):
    return kernels.outer_components(m > 0)


def _component_labels(m):
    return kernels.components(m > 0)


# ---- oriented gradients ----


def hog_36(
    maps: DataFrame,
    keys: Sequence[str],
    *,
    cell_height: int = CELL_HEIGHT,
    cell_width: int = CELL_WIDTH,
    patches: int = 2,
    bins: int = 9,
) -> DataFrame:
    """Magnitude-weighted orientation shares of 2x2 patches per cell, ``f_hog_000``..; an empty patch stays 0."""
    rows = explode_pixels(maps.select(*keys, "height", "width", "gx", "gy"), ["gx", "gy"])
    placed = assign_cell(rows, cell_height=cell_height, cell_width=cell_width)
    sums, shares = _gradient_shares(cell_height, cell_width, patches, bins)
    cell = [*keys, "cell_row", "cell_col"]
    return placed.groupBy(*cell).agg(*sums).select(*cell, *shares)


def _gradient_shares(cell_height: int, cell_width: int, patches: int, bins: int) -> tuple[list[Column], list[Column]]:
    """Aggregates ``_h0``.. of gradient strength by patch and direction, and the shares made of them."""
    gx, gy = F.col("gx"), F.col("gy")

    def patch(offset: Column, length: int) -> Column:
        cuts = [length * k // patches for k in range(1, patches)]
        return total([F.when(offset >= cut, 1).otherwise(0) for cut in cuts])

    where = patch(F.col("y") % cell_height, cell_height) * patches + patch(F.col("x") % cell_width, cell_width)
    code = (where * bins + _bin(orientation(gx, gy), 0, 180, bins)).cast("int")
    size = patches * patches * bins
    sums = [F.sum(F.when(code == k, magnitude(gx, gy)).otherwise(0.0)).alias(f"_h{k}") for k in range(size)]
    shares = []
    for k in range(size):
        first = k // bins * bins
        whole = total([F.col(f"_h{j}") for j in range(first, first + bins)])
        shares.append(ratio(F.col(f"_h{k}"), whole).alias(f"f_hog_{k:03d}"))
    return sums, shares


def _central_gradients(cells: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Pixel rows with central differences, 0 on the border, and their orientation bin weight."""
    rows = _with_neighbours(cells, keys, values, [(-1, 0), (1, 0), (0, -1), (0, 1)])
    gy = F.coalesce(F.col("n1") - F.col("n0"), F.lit(0.0))
    gx = F.coalesce(F.col("n3") - F.col("n2"), F.lit(0.0))
    return rows.select(*keys, "height", "width", "y", "x", magnitude(gx, gy).alias("m"), orientation(gx, gy).alias("a"))


def _clip_norm(values: Column) -> Column:
    """L2 norm, clipped at 0.2, normed again; the small constant keeps empty blocks at 0."""

    def length(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) + 1e-10)

    def unit(v: Column) -> Column:
        return bound(v, lambda a: bound(length(a), lambda n: F.transform(a, lambda x: x / n)))

    return unit(F.transform(unit(values), lambda x: F.least(x, F.lit(0.2))))


def hog_9(cells: DataFrame, keys: Sequence[str], *, values: str = "level", bins: int = 9) -> DataFrame:
    """One orientation histogram per cell, block-normalised, ``hog_bin_0``..``hog_bin_8``."""
    rows = _central_gradients(cells, keys, values)
    code = F.least(F.floor(F.col("a") * bins / 180), F.lit(bins - 1))
    sums = rows.groupBy(*keys).agg(
        *[(F.sum(F.when(code == k, F.col("m")).otherwise(0.0)) / F.count(F.lit(1))).alias(f"s{k}") for k in range(bins)]
    )
    packed = sums.select(*keys, _clip_norm(F.array(*[f"s{k}" for k in range(bins)])).alias("hog"))
    return packed.select(*keys, *[F.get("hog", F.lit(k)).alias(f"hog_bin_{k}") for k in range(bins)])


def hog_dense(
    cells: DataFrame, keys: Sequence[str], *, values: str = "level", size: int = 8, block: int = 2, bins: int = 9
) -> DataFrame:
    """Dense oriented gradients: overlapping blocks of small squares, each block normalised, in one array.

    A 100x75 cell gives 8x11 blocks of 2x2 squares with nine bins, 3168 values.
    """
    rows = _central_gradients(cells, keys, values)
    down, across = F.floor(F.col("height") / size), F.floor(F.col("width") / size)
    squares = rows.select(
        *keys,
        down.alias("down"),
        across.alias("across"),
        F.floor(F.col("y") / size).alias("sy"),
        F.floor(F.col("x") / size).alias("sx"),
        F.least(F.floor(F.col("a") * bins / 180), F.lit(bins - 1)).alias("bin"),
        "m",
    ).where("sy < down AND sx < across")
    sums = squares.groupBy(*keys, "down", "across", "sy", "sx").agg(
        F.array(
            *[F.sum(F.when(F.col("bin") == k, F.col("m")).otherwise(0.0)) / (size * size) for k in range(bins)]
        ).alias("hist")
    )
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(block) for dx in range(block)])
    spread = sums.select("*", F.inline(offsets)).withColumns({"by": F.col("sy") - F.col("dy"), "bx": F.col("sx") - F.col("dx")})
    inside = F.col("by").between(0, F.col("down") - block) & F.col("bx").between(0, F.col("across") - block)
    # A block holds block*block histograms and a cell a fixed number of blocks: both arrays have a known size.
    blocks = spread.where(inside).groupBy(*keys, "by", "bx").agg(
        F.array_sort(F.collect_list(F.struct("dy", "dx", "hist"))).alias("parts")
    )
    normed = blocks.select(*keys, "by", "bx", _clip_norm(F.flatten(F.col("parts.hist"))).alias("values"))
    whole = normed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("by", "bx", "values"))).alias("b"))
    return whole.select(*keys, F.flatten(F.col("b.values")).alias("hog"))


# ---- closing and contours ----


def morph_close(planes: DataFrame, *, values: str = "edge", into: str = "closed") -> DataFrame:
    """5x5 dilation followed by erosion."""
    return _apply(planes, values, kernels.close5, into)


def contour_summary(
    maps: DataFrame, keys: Sequence[str], *, min_area: int = 200, max_area: int = 20000
) -> DataFrame:
    """Outer contours of the closed edge map by area, and edge densities, per image.

    The area of a contour is its number of pixels. Areas are counted where the map is: nothing is shuffled.
    """
    found = maps.withColumn("_areas", kernels.areas_udf()(F.col("edge"), F.col("height"), F.col("width"))["areas"])
    areas, whole = F.col("_areas"), F.lit(0).cast("long")
    kept = F.filter(areas, lambda a: a.between(min_area, max_area))
    covered = F.aggregate(kept, whole, lambda s, a: s + a)
    half = F.floor(F.col("height") / 2)
    line = F.when(F.col("height") > 0, half * F.col("width"))

    def ones(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)

    split = (half * F.col("width")).cast("int")
    upper, lower = ones(F.slice("edge", 1, split)), ones(F.slice("edge", split + 1, F.size("edge")))
    return found.select(
        *keys,
        F.size(areas).cast("long").alias("f_raw_contour_count"),
        F.size(kept).cast("long").alias("f_filtered_contour_count"),
        F.size(F.filter(areas, lambda a: a > max_area // 2)).cast("long").alias("f_large_contour_count"),
        F.when(F.size(kept) > 0, covered / F.size(kept)).otherwise(0.0).alias("f_mean_contour_area"),
        F.coalesce(F.array_max(kept), whole).alias("f_max_contour_area"),
        covered.alias("f_total_contour_area"),
        (upper + lower).alias("f_edge_pixel_count"),
        ((upper + lower) / (F.col("height") * F.col("width"))).alias("f_edge_density"),
        (upper / F.greatest(line, F.lit(1))).alias("f_upper_half_edge_density"),
        (lower / F.greatest(line, F.lit(1))).alias("f_lower_half_edge_density"),
    )


# ---- export ----


def feature_export(
    meta: DataFrame,
    histogram: DataFrame,
    moments: DataFrame,
    hog: DataFrame,
    lbp: DataFrame,
    *,
    key: Sequence[str] = ("image", "cell_row", "cell_col"),
    bins: int = BINS,
) -> DataFrame:
    """Metadata with one feature vector per cell: HSV histogram, moments, dense HOG, binary patterns.

    The vector stays an array inside Spark; :func:`feature_names` gives the column names for a wide sink.
    """
    hsv = [F.col(f"f{i:03d}").cast("double") for i in range(3 * bins, 6 * bins)]
    nine = [F.col(f"{c}_{m}") for c in "hsv" for m in ("mean", "std", "skew")]
    parts = [
        histogram.select(*key, F.array(*hsv).alias("_a")),
        moments.select(*key, F.array(*nine).alias("_b")),
        hog.select(*key, F.col("hog").alias("_c")),
        lbp.select(*key, F.array(*[f"tex_{k:02d}" for k in range(10)]).alias("_d")),
    ]
    joined = meta
    for part in parts:
        joined = joined.join(part, list(key), "left")
    return joined.select(*meta.columns, F.concat("_a", "_b", "_c", "_d").alias("features"))


def feature_names(hog_length: int, *, bins: int = BINS) -> list[str]:
    names = [f"hsv_{i:03d}" for i in range(3 * bins)]
    names += [f"{c}_{m}" for c in "hsv" for m in ("mean", "std", "skew")]
    return names + [f"hog_{i:04d}" for i in range(hog_length)] + [f"lbp_{i:02d}" for i in range(10)]


def widen(df: DataFrame, array: str, names: Mapping[int, str] | Sequence[str]) -> DataFrame:
    """An array column as named columns, for file sinks."""
    listed = list(names.values()) if isinstance(names, Mapping) else list(names)
    plain = [c for c in df.columns if c != array]
    return df.select(*plain, *[F.get(col(array), F.lit(i)).alias(n) for i, n in enumerate(listed)])
