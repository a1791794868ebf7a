"""Kernels against plain implementations, invariances, sources and streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralume.functions import indices as ix
from terralume.functions import rules
from terralume.operators import composite, focal, fusion, geometry, graph, scenes, verdicts
from terralume.operators import pixels as px
from terralume.operators import regions as rg
from terralume.sources import readers
from terralume.streaming import composite as stream


def raster(spark, a, name="m"):
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"x": x.ravel(), "y": y.ravel(), name: a.ravel()}))


def flood_labels(m):
    """Least y * width + x of each 8-connected region, by plain search."""
    out, h, w = {}, *m.shape
    for y, x in zip(*np.nonzero(m)):
        if (x, y) in out:
            continue
        group, todo = {(x, y)}, [(x, y)]
        while todo:
            a, b = todo.pop()
            for c in range(a - 1, a + 2):
                for d in range(b - 1, b + 2):
                    if 0 <= c < w and 0 <= d < h and m[d, c] and (c, d) not in group:
                        group.add((c, d))
                        todo.append((c, d))
        least = min(d * w + c for c, d in group)
        out.update(dict.fromkeys(group, least))
    return out


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_labels_do_not_depend_on_tiles(spark, tile):
    m = np.random.default_rng(3).random((23, 31)) < 0.45
    got = {(r["x"], r["y"]): r["region"] for r in rg.label(raster(spark, m), F.col("m"), 31, tile=tile).collect()}
    assert got == flood_labels(m)


def test_labels_of_two_scenes(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((9, 9)) < 0.5, rng.random((9, 9)) < 0.5
    df = raster(spark, a).withColumn("s", F.lit("a")).unionByName(raster(spark, b).withColumn("s", F.lit("b")))
    got = rg.label(df, F.col("m"), 9, ["s"], tile=3).collect()
    for k, m in (("a", a), ("b", b)):
        assert {(r["x"], r["y"]): r["region"] for r in got if r["s"] == k} == flood_labels(m)


def test_no_pixel_no_region(spark):
    assert rg.label(raster(spark, np.zeros((5, 5), bool)), F.col("m"), 5).count() == 0


def test_components_of_a_path(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in graph.components(edges).collect()} == {0}


def test_morphology(spark):
    m = np.random.default_rng(5).random((12, 15)) < 0.4
    got = focal.close(raster(spark, m), "m", 1, "c").toPandas().sort_values(["y", "x"])["c"].to_numpy().reshape(m.shape)
    grown = geometry.shift_all(m).any(0)
    assert (got == geometry.shift_all(grown, True).all(0)).all()


def test_gaussian(spark):
    v = np.random.default_rng(6).random((8, 11))
    k = np.array(focal.gaussian_kernel(1.0))
    pad = np.pad(v, 4, mode="reflect")
    want = sum(k[i] * k[j] * pad[i : i + 8, j : j + 11] for i in range(9) for j in range(9))
    got = focal.convolve(raster(spark, v, "v"), ["v"], k.tolist()).toPandas().sort_values(["y", "x"])["v"].to_numpy().reshape(v.shape)
    assert got == pytest.approx(want)


def test_quantiles_by_narrowing(spark):
    v = np.random.default_rng(7).normal(size=5000).round(2)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    qs = [0.0, 0.02, 0.5, 0.98, 1.0]
    assert px.quantiles(df, ["v"], qs)["v"] == pytest.approx(np.quantile(v, qs))
    assert px.quantiles(df, ["v"], qs, limit=10)["v"] == pytest.approx(np.quantile(v, qs))


def test_shapes_of_known_figures():
    y, x = np.mgrid[:10, :14]
    box = geometry.metrics(x.ravel(), y.ravel())
    assert (box["area"], box["rectangularity"], box["solidity"], box["aspect"]) == (140, 1.0, 1.0, 1.4)
    line = geometry.metrics(np.arange(40), np.zeros(40, int))
    assert line["aspect"] == 40.0 and line["skeleton_px"] >= 38
    y, x = np.nonzero(np.hypot(*np.mgrid[-15:16, -15:16]) <= 15)
    disc = geometry.metrics(x, y)
    assert disc["solidity"] >= 0.95 and 0.7 <= disc["rectangularity"] <= 0.82
    assert geometry.metrics(np.arange(3), np.zeros(3, int))["rectangularity"] == 0.0


def plain_irmad(b, a):
    """The statistic by numpy on all pixels: generalised eigenvectors instead of whitening, explicit weights."""
    w, last, p = np.ones(len(b)), 0, b.shape[1]
    for _ in range(30):
        z = np.hstack([b, a])
        m = w @ z / w.sum()
        s = ((z - m) * w[:, None]).T @ (z - m) / w.sum()
        sxx, sxy, syy = s[:p, :p] + 1e-9 * np.eye(p), s[:p, p:], s[p:, p:] + 1e-9 * np.eye(p)
        lam, e = np.linalg.eig(np.linalg.solve(sxx, sxy) @ np.linalg.solve(syy, sxy.T))
        e, lam = np.real(e), np.real(lam)
        e = e / np.sqrt(np.einsum("ij,ik,kj->j", e, sxx, e))
        f = np.linalg.solve(syy, sxy.T) @ e
        f = f / np.sqrt(np.einsum("ij,ik,kj->j", f, syy, f))
        rho = np.sqrt(np.clip(lam, 1e-8, 1 - 1e-8))
        t = ((((b - m[:p]) @ e - (a - m[p:]) @ f) ** 2) / np.maximum(2 * (1 - rho), 1e-6)).sum(1)
        if np.abs(np.sort(rho) - last).max() < 1e-4:
            return t
        w, last = (1 + t / 2) * np.exp(-t / 2), np.sort(rho)
    return t


def irmad_rows(spark, b, a):
    return spark.createDataFrame(pd.DataFrame(np.hstack([b, a]), columns=[p + n for p in ("b_", "a_") for n in ix.BANDS]).assign(x=range(len(b)), y=0))


def test_irmad_equals_numpy_and_ignores_gain_and_offset(spark):
    rng = np.random.default_rng(8)
    b = rng.random((600, 4)) * 0.3 + 0.1
    a = b * 0.9 + rng.normal(size=b.shape) * 0.01 * np.array([1, 2, 3, 4])
    a[:20] += 0.2 * rng.random((20, 4))
    want = plain_irmad(b, a)
    assert want[:20].mean() > 5 * want[20:].mean()
    for gain, offset in ((1.0, 0.0), (np.array([1.5, 0.7, 1.1, 2.0]), 0.03)):
        t, _ = px.irmad(irmad_rows(spark, b, a * gain + offset), F.lit(True))
        assert t.orderBy("x").toPandas()["t"].to_numpy() == pytest.approx(want, rel=1e-6 if offset == 0 else 2e-2)


def test_irmad_query_equals_numpy(spark):
    from terralume.plans import fixtures as fx
    from terralume.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = px.reflectance(fx.pair(spark, sf)).where("valid").toPandas()
    # green follows from red and near infrared here, so three bands say it all
    cols = [[f"{p}{n}" for n in ix.BANDS if n != "green"] for p in ("b_", "a_")]
    want = dict(zip(zip(rows["x"], rows["y"]), plain_irmad(*(rows[c].to_numpy(float) for c in cols))))
    got = {(r["x"], r["y"]): r["t"] for r in QUERIES["irmad"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-2, abs=1e-2) for k in want)


def test_irmad_needs_pixels(spark):
    with pytest.raises(ValueError):
        px.irmad(irmad_rows(spark, np.ones((10, 4)), np.ones((10, 4))), F.lit(True))
    with pytest.raises(ValueError):
        px.irmad(irmad_rows(spark, np.ones((10, 4)), np.ones((10, 4))), F.lit(False))


def test_identical_dates_show_no_evidence(spark):
    rows = spark.range(200).select(F.col("id").alias("x"), F.lit(0).alias("y"), *[(F.lit(0.1) + F.rand(k) * 0.2).alias("b_" + b) for k, b in enumerate(ix.BANDS)])
    rows = rows.select("*", *[F.col("b_" + b).alias("a_" + b) for b in ix.BANDS])
    assert px.evidence(px.features(rows)).where("landcover_evidence").count() == 0


def test_detection_finds_planted_changes(spark):
    from terralume.plans.detect import detect_changes, synthetic_pair

    planted = ((40, 40, 5, 5, None, "roof"), (120, 30, 2, 60, None, "asphalt"), (60, 110, 25, 25, "vegetation", "soil"))
    pair = synthetic_pair(spark, 180, 180, planted).persist()
    found = detect_changes(pair, 180, 180, rules.Params(target="all"))
    hit = found.region_pixels.join(pair.select("x", "y", "truth"), ["x", "y"]).agg(F.count("*").alias("n"), F.sum(F.col("truth").cast("int")).alias("t")).first()
    truth = pair.where("truth").count()
    assert hit["t"] / truth > 0.8 and hit["t"] / hit["n"] > 0.8
    stages = [r["n"] for r in found.funnel.orderBy("stage_no").collect()]
    assert len(stages) == 9 and stages[3] <= stages[1]
    pair.unpersist()


def test_detection_query_tells_structures_from_fields(spark):
    from terralume.plans.objects import PLANTED
    from terralume.plans.queries import QUERIES

    rows = QUERIES["detect_changes"](spark, "/root/testdata/sf0.01").collect()
    met = {}
    for y, x, h, w, _, after in PLANTED:
        met[y, x] = [r for r in rows if r["x"] < x + w and x < r["x"] + r["w"] and r["y"] < y + h and y < r["y"] + r["h"]]
    assert any(r["accept"] for r in met[40, 40]) and any(r["accept"] for r in met[60, 150])
    road = max(met[150, 30], key=lambda r: r["area_px"])
    assert road["kind"] == "road-like" and road["accept"] and road["w"] > 60
    assert all(not r["accept"] and r["reason"].startswith("still vegetated afterwards (NDVI") for r in met[240, 60]) and met[240, 60]
    assert all((r["reason"] == "") == r["accept"] for r in rows)
    assert sum(r["accept"] for r in rows) <= 6  # traps: speckles, moisture, a cloud


def test_clouds_are_not_valid(spark):
    from terralume.plans.detect import clear_pair, detect_changes, synthetic_pair
    from terralume.sources.work import WorkFolder

    pair = synthetic_pair(spark, 180, 180, ((60, 110, 25, 25, "vegetation", "soil"),), clouds=((20, 30, 30, 40), (120, 120, 5, 5))).persist()
    found = detect_changes(pair, 180, 180, rules.Params(target="all"))
    assert found.diagnostics["cloud_pct"] == pytest.approx(100 * 30 * 40 / 180**2) and found.diagnostics["snow_pct"] == 0.0
    assert found.funnel.where("stage_no = 1").first()["n"] == 180**2 - 38 * 48
    assert found.region_pixels.where("x BETWEEN 26 AND 73 AND y BETWEEN 16 AND 53").count() == 0
    assert found.region_pixels.join(pair.where("truth"), ["x", "y"]).count() > 500
    with pytest.raises(ValueError):
        clear_pair(synthetic_pair(spark, 60, 60, (), clouds=((0, 0, 60, 55),)), 60, WorkFolder(spark, "clouds"))
    pair.unpersist()


def test_overlap_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    b = pd.DataFrame({"id": np.arange(120), "x": rng.integers(0, 100, 120), "y": rng.integers(0, 100, 120), "w": rng.integers(1, 40, 120), "h": rng.integers(1, 40, 120)})
    got = {(r["a"], r["b"]) for r in rg.overlapping(spark.createDataFrame(b), 0.4, cell=16).collect()}
    want = set()
    for p in b.to_dict("records"):
        for q in b.to_dict("records"):
            iw, ih = min(p["x"] + p["w"], q["x"] + q["w"]) - max(p["x"], q["x"]), min(p["y"] + p["h"], q["y"] + q["h"]) - max(p["y"], q["y"])
            if p["id"] < q["id"] and iw > 0 and ih > 0 and iw * ih / min(p["w"] * p["h"], q["w"] * q["h"]) >= 0.4:
                want.add((p["id"], q["id"]))
    assert got == want


def test_box_overlap_value(spark):
    b = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 5, 0, 10, 10)], "id int, x int, y int, w int, h int")
    assert rg.overlapping(b).first()["overlap"] == 0.5


def test_work_folders_can_be_cleared(spark, monkeypatch, tmp_path):
    import os

    from terralume.sources import work

    monkeypatch.setattr(work.WorkFolder, "made", [])
    folder = work.WorkFolder(spark, "clear")
    assert folder.put("t", spark.range(5)).count() == 5
    path = folder.path.removeprefix("file://")
    assert os.path.exists(path) and work.clear(spark) == 1 and not os.path.exists(path) and work.clear(spark) == 0


def test_ranks_over_several_tasks(spark):
    df = spark.range(500).select(F.col("id").alias("region"), (F.col("id") * 37 % 50 + 1).alias("area_px"), (F.col("id") % 7 + 0.5).alias("significance"))
    got = [(r["id"], r["region"]) for r in rg.ranked(df.repartition(6)).orderBy("id").collect()]
    want = sorted(df.collect(), key=lambda r: (-r["area_px"] * r["significance"], r["region"]))
    assert got == [(k, r["region"]) for k, r in enumerate(want, 1)]
    assert rg.ranked(df.where("region < 0")).count() == 0


def test_containing_equals_every_pair(spark):
    from terralume.operators import scenes

    rng = np.random.default_rng(4)
    boxes = [(i, float(x), float(y), float(x + rng.integers(1, 30)), float(y + rng.integers(1, 30))) for i, (x, y) in enumerate(rng.integers(-50, 200, (60, 2)))]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-60, 240, (300, 2)))], "point_id long, px double, py double")
    bounds = spark.createDataFrame(boxes, "raster_id long, x0 double, y0 double, x1 double, y1 double")
    holds = lambda p: [b[0] for b in boxes if b[1] <= p["px"] <= b[3] and b[2] <= p["py"] <= b[4]]
    want = sorted((p["point_id"], min(holds(p), default=0), bool(holds(p))) for p in points.collect())
    assert sorted(tuple(r) for r in scenes.containing(points, bounds).collect()) == want and any(r[2] for r in want)


def test_majority_takes_the_lowest_of_equals(spark):
    rows = spark.createDataFrame([(1, 6), (1, 2), (1, 0), (1, 0), (1, 0)], "region int, class_code int")
    assert rg.majority(rows).first()["class_code"] == 2


def test_greedy_merge(spark):
    b = spark.createDataFrame([("s", 1, 0, 0, 10, 10, 0.9, ["cc"]), ("s", 2, 1, 1, 10, 10, 0.8, ["sam"]), ("s", 3, 50, 50, 5, 5, 0.7, ["cc"])], "scene string, id int, x int, y int, w int, h int, score double, sources array<string>")
    got = {r["id"]: r["sources"] for r in rg.greedy_merge(b, 30).collect()}
    assert got == {1: ["cc", "sam"], 3: ["cc"]}


def test_missing_detector_is_skipped(spark):
    df, ran = fusion.run_detectors(spark.range(3).withColumnRenamed("id", "x"), ["dino", "structure"])
    assert ran == [] and df.columns == ["x"]


def test_grid_and_season_checks(spark):
    with pytest.raises(ValueError):
        scenes.tiles(10_001, 3000.0, spark)
    s, e = scenes.season(F.lit(2020), 1, 12)
    assert [str(v) for v in spark.range(1).select(s.alias("s"), e.alias("e")).first()] == ["2020-01-01", "2021-01-01"]
    good = {"crs": 32639, "shape": (10, 10), "transform": (10.0, 0, 5.0, 0, -10.0, 7.0)}
    assert scenes.alignment_problems(good, good) == []
    assert len(scenes.alignment_problems(good, {"crs": 1, "shape": (9, 10), "transform": (10.0, 0, 9.0, 0, -10.0, 7.0)})) == 4
    with pytest.raises(ValueError):
        readers.same_config('{"a": 1}', {"a": 2})


def test_composite_arguments():
    assert scenes.argument_problems(35.2, 52.3, 10.0, (2017, 2025), (6, 9), 80, 0.6, 5) == []
    assert len(scenes.argument_problems(89, 181, 10.001, (2020, 2019), (9, 6), 101, 2, 0)) == 8


def test_composite_needs_observations(spark):
    obs = spark.createDataFrame([(1, 0.1, 4), (1, 0.3, 4), (1, 9.0, 3), (2, 0.5, 4)], "k int, b double, scl int")
    got = {r["k"]: (r["clear_observations"], r["b"]) for r in composite.seasonal(obs, ["k"], ["b"], rules.clear_scl(F.col("scl")), 2).collect()}
    assert got == {1: (2, pytest.approx(0.2)), 2: (1, None)}


def test_png_round_trip(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (7, 9, 3)).astype(np.uint8)
    (tmp_path / "S2A_39SXV_20200128_1_L2A_visual.tif.png").write_bytes(readers.write_png(a))
    assert (readers.read_png(readers.write_png(a)) == a).all()
    rows = readers.image_pixels(spark.read.format("binaryFile").load(str(tmp_path))).toPandas().sort_values(["y", "x"])
    assert (rows[["r", "g", "b"]].to_numpy().reshape(7, 9, 3) == a).all()


def test_scene_files(spark, tmp_path):
    for n in ("S2A_39SXV_20200128_1_L2A_red.tif", "S2B_39SXV_20260128_0_L2A_red.tif", "other.tif"):
        (tmp_path / n).write_bytes(b"x")
    files = readers.scene_files(spark, str(tmp_path))
    assert files.count() == 2 and "20260128" in readers.latest_path(files)


def test_sinks(spark, tmp_path):
    regions = spark.createDataFrame([(1, 2, 3, 4, 5, 20)], "id int, x int, y int, w int, h int, area_px int")
    readers.write_regions_csv(regions, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, inferSchema=True).first()["area_px"] == 20
    ring = json.loads(readers.geojson(regions, (10.0, 0.0, 0.0, 0.0, -10.0, 0.0)).first()["feature"])["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] == [20.0, -30.0]
    readers.write_tiles(raster(spark, np.ones((4, 4))), f"{tmp_path}/tiles", 2)
    assert spark.read.parquet(f"{tmp_path}/tiles").where("ty = 1").count() == 8


def test_verdicts_of_unknown_regions_fall_away(spark):
    texts = spark.createDataFrame([(1, '{"regions":[{"id":1,"real_change":true,"category":"x","reason":"y"},{"id":9,"real_change":"yes"},{"id":"z"}]}'), (2, ""), (3, None)], "k int, t string")
    v = verdicts.parse_audit(texts, "k", "t")
    assert {r["id"]: r["real_change"] for r in v.collect()} == {1: True, 9: True}
    regions = spark.createDataFrame([(1,), (2,)], "id int")
    assert {r["id"]: r["status"] for r in verdicts.join_verdicts(regions, v.drop("k")).collect()} == {1: "REAL", 2: "UNREVIEWED"}


def test_audit_in_batches(spark):
    regions = spark.range(1, 20).select(F.col("id").cast("int").alias("id"))
    got = verdicts.audit(regions, lambda rows: str(len(rows)), 8).orderBy("batch").collect()
    assert [(r["batch"], r["answer"]) for r in got] == [(0, "8"), (1, "8"), (2, "3")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.daily_composite(live, late="60 days").writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["day", "user_id", "event_type", "n", "mean"]
    rounded = lambda df: sorted((str(r["day"]), r["user_id"], r["event_type"], r["n"], round(r["mean"] or -1, 6)) for r in df.select(cols).collect())
    assert rounded(spark.table("daily")) == rounded(stream.daily_composite(events))


def test_answer_chunks(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"message":{"content":"hi"},"done":false}\n{"message":{"content":"!"},"done":true}\n{"error":"gone"}\n')
    got = stream.answers(spark.readStream.text(str(tmp_path))).writeStream.format("memory").queryName("chunks").trigger(availableNow=True).start()
    got.awaitTermination()
    rows = spark.table("chunks").collect()
    assert "".join(r["content"] for r in rows) == "hi!" and [r["error"] for r in rows if r["error"]] == ["gone"]


# ------------------------------------------------------------------ regions of the queries, by plain loops


def plain_regions(spark, sf):
    from terralume.plans.queries import QUERIES

    out = {}
    for r in QUERIES["connected_components"](spark, sf).collect():
        out.setdefault(r["region"], set()).add((r["x"], r["y"]))
    return out


def around(p, reach=1):
    return {(p[0] + i, p[1] + j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)}


def plain_shape(pixels):
    """Area, rectangularity, solidity and aspect of a region after closing and filling, on sets of points."""
    grown = set().union(*map(around, pixels))
    shape = {p for p in grown if around(p) <= grown}
    x0, x1, y0, y1 = min(x for x, _ in shape) - 1, max(x for x, _ in shape) + 1, min(y for _, y in shape) - 1, max(y for _, y in shape) + 1
    out, todo = {(x0, y0)}, [(x0, y0)]
    while todo:
        x, y = todo.pop()
        for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if x0 <= q[0] <= x1 and y0 <= q[1] <= y1 and q not in shape and q not in out:
                out.add(q)
                todo.append(q)
    shape = {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} - out
    area = len(shape)
    if area < 16:
        return area, 0.0, 0.0, 1.0
    p = np.array(sorted(shape), float)
    # the hull is where no line through two points has all others on one side
    lines = []
    edge = [q for q in shape if not around(q) <= shape]
    for a in edge:
        for b in edge:
            if a != b:
                side = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
                if (side >= 0).all():
                    lines.append((a, b))
    yy, xx = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    inside = np.ones(yy.shape, bool)
    best = None
    for a, b in lines:
        inside &= (b[0] - a[0]) * (yy - a[1]) - (b[1] - a[1]) * (xx - a[0]) >= 0
        u = np.array([b[0] - a[0], b[1] - a[1]]) / np.hypot(b[0] - a[0], b[1] - a[1])
        w, d = np.ptp(p @ u), np.ptp(p @ np.array([-u[1], u[0]]))
        if best is None or w * d < best[0] * best[1] - 1e-9:
            best = (w, d)
    w, d = best[0] + 1, best[1] + 1
    return area, min(area / (w * d), 1.0), min(area / inside.sum(), 1.0), max(w, d) / min(w, d)


def test_shape_metrics_equal_plain_loops(spark):
    from terralume.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    regions = plain_regions(spark, sf)
    got = {r["region"]: r for r in QUERIES["shape_metrics"](spark, sf).collect()}
    assert got.keys() == regions.keys()
    for k, pixels in regions.items():
        area, box, convex, aspect = plain_shape(pixels)
        assert got[k]["area"] == area
        assert (got[k]["rectangularity"], got[k]["solidity"]) == (pytest.approx(box, abs=0.0051), pytest.approx(convex, abs=0.0051))
        assert got[k]["aspect"] == pytest.approx(aspect, abs=0.051) or box * area < 30  # equal boxes may lie either way
        assert 0 <= got[k]["skeleton_px"] <= area and (area < 16) == (got[k]["skeleton_px"] == 0)


def plain_footprint(region, value):
    cross = lambda ps: ps | {(x + i, y + j) for x, y in ps for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))}
    near = {p for p in cross(cross(region)) if p in value}
    v = np.array([value[p] for p in near])
    if len(v) < 12 or np.ptp(v) < 1e-4:
        return region
    n, edges = np.histogram(v, 256)
    mid = (edges[1:] + edges[:-1]) / 2
    split = max(range(255), key=lambda k: (n[: k + 1].sum() * n[k + 1 :].sum() * ((n[: k + 1] @ mid[: k + 1]) / max(n[: k + 1].sum(), 1) - (n[k + 1 :] @ mid[k + 1 :]) / max(n[k + 1 :].sum(), 1)) ** 2, -k))
    left, pieces = {p for p in near if value[p] >= mid[split]}, []
    while left:
        piece, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            piece.add(p)
            more = around(p) & left
            left -= more
            todo += more
        pieces.append(piece)
    most = max(map(len, pieces))
    kept = set().union(*[p for p in pieces if len(p) >= max(6, 0.08 * most)])
    return kept if len(kept) >= 4 else region


def test_footprints_equal_plain_loops(spark):
    from terralume.plans import fixtures as fx
    from terralume.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    value = {(r["x"], r["y"]): float(abs(r["dq"])) for r in fx.quantity_change(spark, sf).collect()}
    got = {}
    for r in QUERIES["footprint_refine"](spark, sf).collect():
        got.setdefault(r["region"], set()).add((r["x"], r["y"]))
    want = {k: plain_footprint(p, value) for k, p in plain_regions(spark, sf).items()}
    assert got == {k: p for k, p in want.items() if p}


@pytest.mark.parametrize("shift", [(0.0, 0.0), (3.0, -2.0), (-5.0, 4.0), (1.5, 0.25)])
def test_phase_shift_by_blocks(spark, shift):
    """A smooth random raster moved by whole and broken pixels, two scenes at once, one without contrast."""
    rng = np.random.default_rng(9)
    f = np.fft.fftfreq(128)
    soft = np.exp(-40 * (f[:, None] ** 2 + f[None, :] ** 2))
    spectrum = np.fft.fft2(rng.normal(size=(128, 128))) * soft
    move = np.exp(-2j * np.pi * (f[None, :] * shift[0] + f[:, None] * shift[1]))
    one, two = np.real(np.fft.ifft2(spectrum)), np.real(np.fft.ifft2(spectrum * move))
    y, x = np.mgrid[:128, :128]
    pdf = pd.DataFrame({"tile": "a", "x": x.ravel(), "y": y.ravel(), "v": one.ravel(), "w": two.ravel()})
    flat = pd.DataFrame({"tile": "b", "x": x.ravel(), "y": y.ravel(), "v": 1.0, "w": 2.0})
    (got,) = focal.phase_shift(spark.createDataFrame(pd.concat([pdf, flat])), "v", "w", ("tile",), 32).collect()
    assert got["tile"] == "a" and got["share"] > 0.3
    assert (got["sub_dx"], got["sub_dy"]) == (pytest.approx(shift[0], abs=0.35), pytest.approx(shift[1], abs=0.35))
    if shift != (1.5, 0.25):
        assert (got["dx"], got["dy"]) == shift


def test_utm_there_and_back(spark):
    rng = np.random.default_rng(2)
    points = pd.DataFrame({"e": rng.uniform(200_000, 800_000, 200), "n": rng.uniform(1e5, 7.5e6, 200)})
    e, n = ix.utm_forward(*ix.utm_inverse(F.col("e"), F.col("n"), 33), 33)
    got = spark.createDataFrame(points).select("e", "n", e.alias("e2"), n.alias("n2")).toPandas()
    assert np.abs(got["e"] - got["e2"]).max() < 0.05 and np.abs(got["n"] - got["n2"]).max() < 0.05


def test_warp_and_back_stays_within_a_pixel(spark):
    """A plane raster that holds its own columns and lines, to the next zone and back: values are places, so they tell the error in pixels."""
    here, there = (33, (10.0, 0.0, 500000.0, 0.0, -10.0, 4000000.0)), (34, (10.0, 0.0, -40400.0, 0.0, -10.0, 4016900.0))
    source = raster(spark, np.zeros((60, 60)), "v").select("x", "y", F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"))
    wide = raster(spark, np.zeros((130, 130)), "v").select("x", "y")
    for smooth, most in ((False, 1.01), (True, 0.02)):
        away = focal.warp_utm(source, wide, ["cx", "cy"], here, there, smooth)
        back = focal.warp_utm(away, source.select("x", "y"), ["cx", "cy"], there, here, smooth)
        inner = back.where("x BETWEEN 3 AND 56 AND y BETWEEN 3 AND 56").toPandas()
        assert len(inner) == 54 * 54
        assert max(np.abs(inner["cx"] - inner["x"]).max(), np.abs(inner["cy"] - inner["y"]).max()) <= most


def test_bucketed_scenes_join_where_they_lie(spark, tmp_path):
    from terralume.sources import readers

    rows = raster(spark, np.arange(40 * 50).reshape(40, 50) + 1.0, "v")
    for b in ix.BANDS:
        rows = rows.withColumn(b, F.col("v"))
    sides = [readers.write_bucketed(rows.drop("v"), f"bucketed_{k}", f"file://{tmp_path}/{k}", 16, 4) for k in "ab"]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with readers.co_located(spark):
            both = px.pair(*sides, ("ty", "tx", "y", "x"))
            tiles = both.groupBy("ty", "tx").agg(F.sum("b_nir").alias("n"))
            plan = tiles._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" in plan
            assert both.count() == 2000 and sum(r["n"] for r in tiles.collect()) == 2000 * 2001 / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for k in "ab":
            spark.sql(f"DROP TABLE bucketed_{k}")


@pytest.mark.parametrize(("width", "height", "size", "stride"), [(50, 37, 16, 10), (12, 40, 16, 10), (36, 36, 16, 10), (9, 23, 4, 6)])
def test_patches_of_a_pixel_are_found_by_arithmetic(spark, width, height, size, stride):
    starts = lambda n: sorted({*range(0, max(n - size, 0) + 1, stride), max(n - size, 0)})
    xs, ys = starts(width), starts(height)
    places = [(x, y) for x in range(-1, width + 1) for y in range(-1, height + 1)] + [(None, 3), (3, None)]
    got = composite.in_patches(spark.createDataFrame(places, "x long, y long"), width, height, size, stride)
    inside = lambda v, all_: [s for s in all_ if v is not None and s <= v < s + size]
    want = [(x, y, a, b, ys.index(b) * len(xs) + xs.index(a)) for x, y in places for a in inside(x, xs) for b in inside(y, ys)]
    assert sorted(map(tuple, got.select("x", "y", "px", "py", "patch").collect())) == sorted(want)


def test_the_plan_of_patches_does_not_grow_with_the_raster(spark):
    pixels = spark.range(10).select((F.col("id") % 5).alias("x"), F.col("id").alias("y"))
    size = lambda height: len(composite.in_patches(pixels, 50, height, 16, 10)._jdf.queryExecution().optimizedPlan().toString())
    assert size(1_000_006) < size(106) + 200


@pytest.mark.parametrize(("name", "taps"), [("bilinear", (0, 1)), ("bicubic", (-1, 0, 1, 2))])
def test_resampling_by_plain_loops(spark, name, taps):
    """Holes, border and fine pixels beyond it as by the sum over all neighbours; no row is made for a neighbour of a fine pixel."""
    cubic = lambda d: 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3
    weight = (lambda d: 1 - d) if name == "bilinear" else cubic
    rng = np.random.default_rng(5)
    w, h = 5, 4
    coarse = {(x, y): float(rng.integers(0, 900)) for x in range(w) for y in range(h) if rng.random() < 0.8}
    fine = [(x, y) for x in range(-3, 2 * w + 6) for y in range(-3, 2 * h + 6)]
    want = {}
    for x, y in fine:
        fx_, fy_ = (x + 0.5) / 2 - 0.5, (y + 0.5) / 2 - 0.5
        for i in taps:
            for j in taps:
                at = min(w - 1, max(0, int(np.floor(fx_)) + i)), min(h - 1, max(0, int(np.floor(fy_)) + j))
                if at in coarse:
                    want[x, y] = want.get((x, y), 0.0) + weight(abs(fx_ - np.floor(fx_) - i)) * weight(abs(fy_ - np.floor(fy_) - j)) * coarse[at]
    table = spark.createDataFrame([(x, y, v) for (x, y), v in coarse.items()], "x long, y long, v double")
    places = spark.createDataFrame(fine, "x long, y long")
    found = getattr(focal, name)(table, places, 2, "v", w, h)
    got = {(r["x"], r["y"]): r["v"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_shuffle_files_of_a_written_table_go(spark):
    import time

    from terralume.sources.work import CLEAN, WorkFolder

    found = lambda: sum(1 for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_"))
    was, before = spark.conf.get(CLEAN), found()
    made = WorkFolder(spark, "cleaned").put("t", spark.range(1000).repartition(7, "id"))
    for _ in range(20):
        if found() <= before:
            break
        time.sleep(0.25)
    assert found() <= before and spark.conf.get(CLEAN) == was
    assert made.count() == 1000


def test_equal_bounds_and_places_meet_once(spark):
    points = spark.createDataFrame([(k, 5.5, 5.5) for k in range(400)] + [(400, 50.0, 50.0), (401, None, 1.0)], "point_id long, px double, py double")
    bounds = spark.createDataFrame([(k, 0.0, 0.0, 10.0, 10.0) for k in range(300, 0, -1)] + [(0, 90.0, 90.0, 95.0, 95.0)], "raster_id long, x0 double, y0 double, x1 double, y1 double")
    got = scenes.containing(points, bounds)
    assert sorted(map(tuple, got.collect())) == [(k, 1, True) for k in range(400)] + [(400, 0, False), (401, 0, False)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [px" in plan and "Aggregate [x0" in plan  # places and boxes are made one before they meet


def test_tiles_share_folders(spark, tmp_path):
    import os

    lines = 16 * readers.TILE_ROWS
    rows = spark.range(lines * 4).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"))
    readers.write_tiles(rows, f"{tmp_path}/t", 4)
    folders = [f for f in os.listdir(f"{tmp_path}/t") if "=" in f]
    assert len(folders) == 4
    got = readers.tile_window(spark, f"{tmp_path}/t", 1, 250, 2, 20, 4)
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [(x, y) for x in (1, 2) for y in range(250, 270)] and "tile_band" not in got.columns


def test_semantic_filter_joins_its_tables_once(spark, monkeypatch):
    from terralume.plans import objects

    seen, plain = [], px.quantiles
    monkeypatch.setattr(objects.px, "quantiles", lambda df, *a: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *a))
    assert objects.semantic_filter(spark, "/root/testdata/sf0.001").count()
    assert len(seen) == 1 and "lineitem" not in seen[0] and "Exchange" not in seen[0]
