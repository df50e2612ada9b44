"""Array kernels for steps that chain neighbourhoods or iterate, where column expressions would be far slower.

Each takes planes of one shape as an array whose last two axes are rows and columns: one plane, or a stack of the planes
that an Arrow batch holds. Spark decides which planes meet in a task, and does all grouping and joining.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Binomial 5-tap blur, tangents of 22.5 and 67.5 degrees.
BLUR = np.array([1, 4, 6, 4, 1]) / 16
TAN_LOW, TAN_HIGH = 0.41421356237309503, 2.414213562373095
#: Pixels stacked for one kernel call; larger planes go one by one.
STACK_PIXELS = 1_000_000


def _pad(m: np.ndarray, n: int, **how: object) -> np.ndarray:
    return np.pad(m, [(0, 0)] * (m.ndim - 2) + [(n, n), (n, n)], **how)


def _shift(m: np.ndarray, dy: int, dx: int, fill: float = 0) -> np.ndarray:
    """``out[y, x] = m[y + dy, x + dx]``, ``fill`` outside."""
    n = max(abs(dy), abs(dx))
    padded = _pad(m, n, constant_values=fill)
    h, w = m.shape[-2:]
    return padded[..., n + dy : n + dy + h, n + dx : n + dx + w]


def _mirror(m: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The same with reflect-101 borders."""
    n = max(abs(dy), abs(dx))
    h, w = m.shape[-2:]
    return _pad(m, n, mode="reflect")[..., n + dy : n + dy + h, n + dx : n + dx + w]


def blur(m: np.ndarray) -> np.ndarray:
    down = sum(k * _mirror(m, i - 2, 0) for i, k in enumerate(BLUR))
    return sum(k * _mirror(down, 0, i - 2) for i, k in enumerate(BLUR))


def gradients(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3x3 Sobel in x and y."""
    gx = sum(k * (_mirror(m, dy, 1) - _mirror(m, dy, -1)) for dy, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (_mirror(m, 1, dx) - _mirror(m, -1, dx)) for dx, k in ((-1, 1), (0, 2), (1, 1)))
    return gx, gy


def laplacian(m: np.ndarray) -> np.ndarray:
    return _mirror(m, -1, 0) + _mirror(m, 1, 0) + _mirror(m, 0, -1) + _mirror(m, 0, 1) - 4 * m


def _roots(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """The lowest index of each pixel's component, counted over the whole stack; pixels outside the mask have their own.

    Roots hook onto the lower of two neighbours and then jump along their own pointers, so long curves settle in a
    logarithmic number of rounds.
    """
    w = mask.shape[-1]
    index = np.arange(mask.size).reshape(mask.shape)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    ends = []
    for dy, dx in steps:
        both = mask & _shift(mask, dy, dx, False)
        ends.append(np.stack([index[both], index[both] + dy * w + dx]))
    u, v = np.concatenate(ends, axis=1)
    root = np.arange(mask.size)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root.reshape(mask.shape)


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Component labels: 1 + the lowest flat index of the component in its plane, 0 outside the mask."""
    pixels = mask.shape[-2] * mask.shape[-1]
    return np.where(mask, _roots(mask, diagonal) % max(pixels, 1) + 1, 0)


def edges(gx: np.ndarray, gy: np.ndarray, low: float, high: float) -> np.ndarray:
    """Gradient ridges above ``low`` that connect to one above ``high``."""
    m, ax, ay = np.abs(gx) + np.abs(gy), np.abs(gx), np.abs(gy)
    flat, steep = ay < TAN_LOW * ax, ay > TAN_HIGH * ax
    along = (m > _shift(m, 0, -1)) & (m >= _shift(m, 0, 1))
    across = (m > _shift(m, -1, 0)) & (m >= _shift(m, 1, 0))
    falling = (m > _shift(m, -1, -1)) & (m > _shift(m, 1, 1))
    rising = (m > _shift(m, -1, 1)) & (m > _shift(m, 1, -1))
    ridge = np.where(flat, along, np.where(steep, across, np.where(gx * gy < 0, rising, falling)))
    weak = ridge & (m > low)
    root = _roots(weak)
    strong = np.unique(root[weak & (m > high)])
    return weak & np.isin(root, strong)


def outer_components(mask: np.ndarray) -> np.ndarray:
    """Labels of the components not enclosed by another one; enclosed ones are 0."""
    framed = _pad(mask, 1)
    around = _roots(~framed, diagonal=False)
    open_side = around == around[..., :1, :1]
    touches = _shift(open_side, 0, 1) | _shift(open_side, 0, -1) | _shift(open_side, 1, 0) | _shift(open_side, -1, 0)
    root = _roots(mask)
    outer = np.unique(root[mask & touches[..., 1:-1, 1:-1].astype(bool)])
    return np.where(np.isin(root, outer), components(mask), 0)


def contour_marks(mask: np.ndarray, cell_height: int, cell_width: int) -> np.ndarray:
    """1 at the lowest pixel of every outer component of each cell crop, else 0; pixels beyond the whole cells are 0."""
    down, across = mask.shape[-2] // cell_height, mask.shape[-1] // cell_width
    whole = mask[..., : down * cell_height, : across * cell_width]
    cells = whole.reshape(-1, down, cell_height, across, cell_width).swapaxes(2, 3)
    label = outer_components(cells)
    own = np.arange(1, cell_height * cell_width + 1).reshape(cell_height, cell_width)
    marks = np.zeros(mask.shape, np.int64)
    marks[..., : down * cell_height, : across * cell_width] = (label == own).swapaxes(2, 3).reshape(whole.shape)
    return marks


def contour_areas(mask: np.ndarray) -> list[np.ndarray]:
    """The pixels of each outer component, one array per plane of the stack."""
    return [np.bincount(plane.ravel())[1:] for plane in outer_components(mask)]


def close5(m: np.ndarray) -> np.ndarray:
    """5x5 dilation, then erosion; pixels outside never decide."""
    shifts = range(-2, 3)
    wide = np.max([_shift(m, 0, d, -np.inf) for d in shifts], axis=0)
    wide = np.max([_shift(wide, d, 0, -np.inf) for d in shifts], axis=0)
    thin = np.min([_shift(wide, 0, d, np.inf) for d in shifts], axis=0)
    return np.min([_shift(thin, d, 0, np.inf) for d in shifts], axis=0)


def _stacked(values: pd.Series, height: pd.Series, width: pd.Series, kernel: Callable[..., tuple]) -> list[list[np.ndarray]]:
    """The flat results of a kernel for each plane, called once per stack of planes of one shape."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for place, shape in enumerate(zip(height, width)):
        shapes.setdefault(shape, []).append(place)
    out: list[list[np.ndarray]] = [[]] * len(values)
    for (h, w), places in shapes.items():
        step = max(1, STACK_PIXELS // max(h * w, 1))
        for begin in range(0, len(places), step):
            part = places[begin : begin + step]
            results = kernel(np.stack([np.asarray(values.iloc[i], float).reshape(h, w) for i in part]))
            for number, i in enumerate(part):
                out[i] = [result[number].ravel() for result in results]
    return out


def planes_udf(kernel: Callable[[np.ndarray], tuple], names: list[str], elements: list[str]):
    """Arrow UDF ``(values, height, width) -> struct of arrays`` from a kernel with one result per name."""

    def run(values: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_stacked(values, height, width, kernel), columns=names)

    run.__annotations__ = {"values": pd.Series, "height": pd.Series, "width": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ", ".join(f"{n} array<{e}>" for n, e in zip(names, elements)))


def plane_udf(kernel: Callable[[np.ndarray], np.ndarray], element: str = "double"):
    """Arrow UDF ``(values, height, width) -> array`` from a kernel on planes."""
    dtype = np.float64 if element == "double" else np.int64

    def run(values: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        found = _stacked(values, height, width, lambda m: (kernel(m).astype(dtype),))
        return pd.Series([own[0] for own in found])

    run.__annotations__ = {"values": pd.Series, "height": pd.Series, "width": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, f"array<{element}>")


def areas_udf():
    """Arrow UDF ``(edge, height, width) -> areas`` of the outer contours of the closed edge map."""

    def areas(m: np.ndarray) -> tuple:
        return ([own[own > 0] for own in contour_areas(close5(m) > 0)],)

    return planes_udf(areas, ["areas"], ["bigint"])


def edge_maps_udf(low: float, high: float, smooth: bool, cell: tuple[int, int] | None = None):
    """Arrow UDF giving Sobel, Laplacian and edge planes together, so a plane crosses to Python once.

    With a cell size there is a fifth plane, which marks every outer contour of a cell at one pixel.
    """

    def maps(m: np.ndarray) -> tuple:
        m = blur(m) if smooth else m
        gx, gy = gradients(m)
        edge = edges(gx, gy, low, high)
        marks = () if cell is None else (contour_marks(edge, *cell),)
        return gx, gy, laplacian(m), edge.astype(np.int64), *marks

    names, elements = ["gx", "gy", "laplacian", "edge"], ["double"] * 3 + ["bigint"]
    return planes_udf(maps, names + ["contour"] * (cell is not None), elements + ["bigint"] * (cell is not None))


def threshold_labels_udf(names: list[str], thresholds: list[float]):
    """Arrow UDF giving the component labels above each threshold, all from one crossing."""

    def labels(m: np.ndarray) -> tuple:
        return tuple(components(m > t).astype(np.int64) for t in thresholds)

    return planes_udf(labels, names, ["bigint"] * len(names))


def decode_udf():
    """Arrow UDF ``(bytes, channels) -> b, g, r`` planes of a decoded image; a grey one repeats its only channel."""

    def run(data: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, n in zip(data, channels):
            pixels = np.frombuffer(raw, np.uint8).reshape(-1, n).astype(np.int32)
            rows.append([pixels[:, min(c, n - 1)] for c in range(3)])
        return pd.DataFrame(rows, columns=["b", "g", "r"])

    run.__annotations__ = {"data": pd.Series, "channels": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "b array<int>, g array<int>, r array<int>")
