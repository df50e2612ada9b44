"""Plane features and components against plain loops on random planes, and images from files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfare.functions import kernels
from gridfare.operators import checks, cleaning, components, grid
from gridfare.operators import planes as pl
from gridfare.sources import annotations as notes
from gridfare.sources.images import read_images

RNG = np.random.default_rng(5)


def _flood(mask, diagonal=True):
    """Components by flood fill: 1 + lowest flat index."""
    h, w = mask.shape
    out = np.zeros((h, w), int)
    for start in range(h * w):
        y, x = divmod(start, w)
        if not mask[y, x] or out[y, x]:
            continue
        stack = [(y, x)]
        while stack:
            y, x = stack.pop()
            if not (0 <= y < h and 0 <= x < w) or not mask[y, x] or out[y, x]:
                continue
            out[y, x] = start + 1
            stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if diagonal or abs(dy) + abs(dx) == 1]
    return out


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.8, 1.0])
def test_components_equal_flood_fill(share, diagonal):
    for shape in ((8, 8), (1, 9), (30, 17)):
        mask = RNG.random(shape) < share
        assert (kernels.components(mask, diagonal) == _flood(mask, diagonal)).all()


def test_a_spiral_is_one_component():
    n = 61
    mask = np.zeros((n, n), bool)
    y = x = 0
    dy, dx, mask[0, 0] = 0, 1, True
    while True:
        ahead = (y + 2 * dy, x + 2 * dx)
        inside = 0 <= y + dy < n and 0 <= x + dx < n
        if not inside or (0 <= ahead[0] < n and 0 <= ahead[1] < n and mask[ahead]):
            dy, dx = dx, -dy
            side = (y + 2 * dy, x + 2 * dx)
            if mask[y + dy, x + dx] or (0 <= side[0] < n and 0 <= side[1] < n and mask[side]):
                break
        y, x = y + dy, x + dx
        mask[y, x] = True
    assert set(np.unique(kernels.components(mask))) == {0, 1}


def test_nested_components_are_not_outer():
    mask = np.zeros((9, 9), bool)
    mask[1:8, 1:8] = True
    mask[2:7, 2:7] = False
    mask[4, 4] = True
    mask[0, 8] = True
    assert len(np.unique(kernels.outer_components(mask))) - 1 == len(np.unique(kernels.components(mask))) - 2


def test_blur_mirrors_its_border():
    m = RNG.integers(0, 255, (7, 9)).astype(float)
    padded = np.pad(m, 2, mode="reflect")
    taps = np.array([1, 4, 6, 4, 1]) / 16
    expected = sum(taps[i] * taps[j] * padded[i : i + 7, j : j + 9] for i in range(5) for j in range(5))
    assert np.allclose(kernels.blur(m), expected)


def test_closing_fills_small_gaps():
    m = np.zeros((12, 12))
    m[5, 2:10] = 1
    m[5, 6] = 0
    closed = kernels.close5(m)
    assert closed[5, 6] == 1 and closed[0, 0] == 0


def _planes(spark, arrays, name="level"):
    rows = [(f"i{k}", a.shape[0], a.shape[1], a.ravel().tolist()) for k, a in enumerate(arrays)]
    return spark.createDataFrame(rows, f"image string, height int, width int, {name} array<double>")


def test_cells_cover_the_plane(spark):
    m = np.arange(48.0).reshape(6, 8)
    cut = pl.cut_cells(_planes(spark, [m]), "level", cell_height=3, cell_width=2).collect()
    assert len(cut) == 8
    for r in cut:
        y, x = r["cell_row"] * 3, r["cell_col"] * 2
        assert r["level"] == m[y : y + 3, x : x + 2].ravel().tolist()


def test_glcm_against_loops(spark):
    m = RNG.integers(0, 256, (5, 6)).astype(float)
    row = pl.glcm_features(_planes(spark, [m]), ["image"]).first()
    q = (m // 8).astype(int)
    for a, (dy, dx) in enumerate(pl.ANGLES):
        p = np.zeros((32, 32))
        for y in range(5):
            for x in range(6):
                if 0 <= y + dy < 5 and 0 <= x + dx < 6:
                    p[q[y, x], q[y + dy, x + dx]] += 1
                    p[q[y + dy, x + dx], q[y, x]] += 1
        p /= p.sum()
        i, j = np.indices(p.shape)
        mean = (i * p).sum()
        deviation = ((i - mean) ** 2 * p).sum()
        expected = [(p * (i - j) ** 2).sum(), (p / (1 + (i - j) ** 2)).sum(), np.sqrt((p * p).sum()),
                    ((i - mean) * (j - mean) * p).sum() / deviation]
        for k in range(4):
            assert row[f"tex_{10 + 4 * k + a:02d}"] == pytest.approx(expected[k])


def test_a_flat_cell(spark):
    flat = _planes(spark, [np.full((4, 4), 9.0)])
    texture = pl.glcm_features(flat, ["image"]).first()
    assert texture["tex_10"] == 0 and texture["tex_22"] == 1
    assert sum(pl.lbp_histogram(flat, ["image"]).first()[1:]) == pytest.approx(1, abs=1e-5)
    assert list(pl.hog_9(flat, ["image"]).first()[1:]) == [0.0] * 9


def test_hog_patches_sum_to_one_or_zero(spark):
    maps = pl.edge_maps(_planes(spark, [RNG.integers(0, 255, (8, 8)).astype(float), np.zeros((8, 8))]))
    for row in pl.hog_36(maps, ["image"], cell_height=4, cell_width=4).collect():
        for k in range(4):
            assert round(sum(row[f"f_hog_{i:03d}"] for i in range(9 * k, 9 * k + 9)), 6) in (0.0, 1.0)


def test_dense_hog_of_a_full_cell_has_3168_values(spark):
    dense = pl.hog_dense(_planes(spark, [RNG.integers(0, 255, (75, 100)).astype(float)]), ["image"]).first()
    assert len(dense["hog"]) == 3168


def test_histograms_count_every_pixel(spark):
    rows = [(0, int(r), int(g), int(b)) for r, g, b in RNG.integers(0, 256, (500, 3))]
    pixels = spark.createDataFrame(rows, "image int, r int, g int, b int")
    row = pl.colour_histogram(pixels, ["image"]).first()
    for k in range(6):
        assert sum(row[f"f{i:03d}"] for i in range(32 * k, 32 * k + 32)) == 500


def test_cells_are_dealt_out_once(spark, sf):
    """Histograms of cells are counted where the cells were dealt out to, in as many tasks as planes ask for (F7, F8)."""
    from gridfare.plans import catalog

    for name, most in (("colour_histogram", 2), ("feature_export", 4)):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") >= most


def test_component_sizes_add_up(spark):
    maps = [RNG.random((8, 8)) for _ in range(20)]
    planes = _planes(spark, maps, "map")
    for row in components.component_stats(planes, ["image"]).collect():
        m = maps[int(row["image"][1:])]
        for t, name in ((0.3, "t030"), (0.5, "t050"), (0.7, "t070")):
            sizes = sorted(np.unique(_flood(m > t), return_counts=True)[1][0 if (m > t).all() else 1 :], reverse=True)
            assert row[f"f_occ_cells_{name}"] == (m > t).sum() == sum(sizes)
            assert row[f"f_component_count_{name}"] == len(sizes)
            assert row[f"f_largest_component_{name}"] == (sizes[0] if sizes else 0)
            assert row[f"f_second_largest_component_{name}"] == (sizes[1] if len(sizes) > 1 else 0)
    assert len(components.count_feature_columns()) == 38


def test_label_totals(spark):
    m = np.zeros((8, 8))
    m[0, 0] = m[7, 6:] = 1
    marked = components.grid_components(_planes(spark, [m], "map"), values="map", above=0.5)
    assert sorted(r["cells"] for r in components.label_totals(marked, ["image"]).collect()) == [1, 2]


# ---- files ----


def _png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_from_files(spark, tmp_path):
    picture = RNG.integers(0, 256, (6, 8, 3), dtype=np.uint8)
    (tmp_path / "sub").mkdir()
    _png(tmp_path / "sub" / "img_1.png", picture)
    (tmp_path / "img_2.png").write_bytes(b"no picture")
    (tmp_path / "notes.txt").write_text("x")
    images = read_images(spark, str(tmp_path))
    assert images.count() == 2
    assert [r["origin"].split("/")[-1] for r in cleaning.undecodable(images).collect()] == ["img_2.png"]
    sizes = images.select("image.*")
    kept, other = cleaning.size_gate(sizes, width=8, height=6)
    assert (kept.count(), other.count()) == (1, 1)
    assert checks.check_image_size(sizes, width=8, height=6).count() == 1
    pixels = pl.explode_pixels(pl.image_planes(images)).collect()
    found = np.zeros_like(picture)
    for p in pixels:
        found[p["y"], p["x"]] = (p["r"], p["g"], p["b"])
    assert (found == picture).all()


def test_wide_annotations_need_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Image File Name,Train Or Test,c01\nimg_1.jpg,Train,3\n")
    with pytest.raises(ValueError, match="c02"):
        notes.read_annotations(spark, str(tmp_path / "a.csv"))


def test_feature_columns_are_numeric_and_prefixed(spark):
    df = spark.createDataFrame([(1.0, 2, "x", 3.0, 4)], "f000 double, fold_id int, f_text string, tex_00 double, label int")
    assert grid.feature_columns(df, exclude=["fold_id"]) == ["f000", "tex_00"]
    assert checks.check_required_columns(df, ["f000", "count"]) == ["count"]


def test_reserved_numbers(spark):
    rows = [(f"a{i:03d}", i % 4 == 0) for i in range(40)]
    images = spark.createDataFrame(rows, "name string, no_player boolean")
    plain = cleaning.sequential_rename(images, reserved=(5, 14)).collect()
    numbers = [r["image_num"] for r in plain]
    assert sorted(numbers) == list(range(1, 41))
    assert {r["image_num"] for r in plain if r["no_player"]} == set(range(5, 15))
    # A full block: the rest goes on after the highest number, and every number is used once.
    over = cleaning.sequential_rename(images, reserved=(5, 10)).collect()
    assert sorted(r["image_num"] for r in over) == list(range(1, 41))
    assert sorted(r["image_num"] for r in over if r["no_player"]) == [5, 6, 7, 8, 9, 10, 37, 38, 39, 40]


def test_merge_reports_in_strict_mode(spark):
    from gridfare.operators import merge

    base = spark.createDataFrame([("a", 0, 0), ("a", 0, 1)], "image string, cell_row int, cell_col int")
    some = base.where("cell_col = 0")
    assert merge.merge_match_report(base, {"edge": some}).count() == 1
    with pytest.raises(ValueError):
        merge.merge_match_report(base, {"edge": some}, strict=True)
    assert "image_num" not in merge.drop_image_number(base.withColumn("image_num", F.lit(1))).columns


def test_export_has_the_named_length(spark, sf):
    from gridfare.plans import catalog

    rows = catalog.QUERIES["feature_export"](spark, sf)
    # Dense squares of 2 pixels on a 4x4 cell: one block of 36 values.
    assert rows.agg(F.max("pos")).first()[0] + 1 == 96 + 9 + 36 + 10 == len(pl.feature_names(36))


def test_unknown_sizes_contents_and_readability_are_reported(spark):
    sized = spark.createDataFrame([("a", 800, 600), ("b", None, 600), ("c", 800, None), ("d", 1, 1)], "name string, width int, height int")
    assert {r["name"] for r in checks.check_image_size(sized).collect()} == {"b", "c", "d"}
    files = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", None)], "name string, content string")
    kept = {r["name"]: r["copies"] for r in cleaning.dedupe_by_hash(files).collect()}
    assert kept == {"a": 2, "c": 1, "d": 1}
    seen = spark.createDataFrame([("a", True), ("b", None)], "name string, ok boolean")
    found = cleaning.missing_and_unreadable(seen.select("name"), seen, readable=F.col("ok"))
    assert [tuple(r) for r in found.collect()] == [("b", "unreadable")]


def test_all_features_are_correlated_and_reported(spark):
    from gridfare.operators import explore

    rng = np.random.default_rng(0)
    data = rng.standard_normal((80, 45))
    data[:, 44] = 3.0
    rows = [tuple(None if (i + j) % 13 == 0 else float(x) for j, x in enumerate(row)) for i, row in enumerate(data)]
    names = [f"c{j}" for j in range(45)]
    df = spark.createDataFrame(rows, names).repartition(3)
    found = {(r["a"], r["b"]): r["corr"] for r in explore.correlation_matrix(df, names).collect()}
    assert len(found) == 45 * 44 // 2
    table = df.toPandas()
    for a, b in (("c7", "c3"), ("c43", "c0"), ("c20", "c19")):
        assert found[a, b] == pytest.approx(table[a].corr(table[b]))
    assert found["c44", "c1"] is None
    report = explore.skewness_report(df, names, limit=0.3)
    skews = [r["skew"] for r in report.collect() if r["skew"] is not None]
    assert report.count() == 45 and skews == sorted(skews, reverse=True)
    assert explore.most_skewed(report, n=3).count() == 3


def test_stacked_planes_equal_single_ones():
    from gridfare.functions import kernels

    rng = np.random.default_rng(2)
    planes = np.floor(rng.random((5, 9, 13)) * 255)
    masks = planes > 120
    for kernel in (kernels.blur, kernels.laplacian, kernels.close5):
        assert np.array_equal(kernel(planes), np.stack([kernel(p) for p in planes]))
    for kernel in (kernels.components, kernels.outer_components):
        assert np.array_equal(kernel(masks), np.stack([kernel(m) for m in masks]))
    gx, gy = kernels.gradients(planes)
    apart = np.stack([kernels.edges(*kernels.gradients(p), 200, 500) for p in planes])
    assert np.array_equal(kernels.edges(gx, gy, 200, 500), apart)
    marks = kernels.contour_marks(masks, 4, 5)
    for plane, mask in zip(marks, masks):
        for r in range(2):
            for c in range(2):
                cut = np.s_[4 * r : 4 * r + 4, 5 * c : 5 * c + 5]
                own = kernels.outer_components(mask[cut])
                assert plane[cut].sum() == len(set(own.ravel()) - {0})
    assert marks[:, 8:].sum() == marks[:, :, 10:].sum() == 0
