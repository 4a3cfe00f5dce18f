"""Round trips of the files beside a sequence."""

import math

from pixelweave.sources import files


def test_frames_are_ordered_by_name(spark):
    paths = spark.createDataFrame([(p,) for p in ("/a/b10.tif", "/a/b9.TIFF", "/a/notes.txt", "/a/a.tif")], "path string")
    assert [(r.frame_idx, r.base_name) for r in files.frames(paths).orderBy("frame_idx").collect()] == [(0, "a"), (1, "b10"), (2, "b9")]


def test_features_round_trip(spark, tmp_path):
    names, folder = ("size", "width"), f"{tmp_path}/f"
    rows = [(1, 0.5, float("inf")), (2, float("nan"), -3.0)]
    files.write_features(spark.createDataFrame(rows, "group_id long, size double, width double"), folder, names)
    found = sorted(map(tuple, files.read_features(spark, folder, names).collect()))
    assert found[0] == rows[0] and math.isnan(found[1][1]) and found[1][2] == -3.0
    assert files.read_features(spark, folder, ("width", "size")).count() == 0
    files.write_features(spark.createDataFrame([(9, 0.0, 0.0)], "group_id long, size double, width double"), folder, names)
    assert files.read_features(spark, folder, names).count() == 2
    for kind, text in (("positive", "1,2\nx,3\n7\n"), ("negative", "4\n\n4,5\n\n")):
        (tmp_path / f"f/{kind}_data.csv").write_text(text)
    assert sorted(map(tuple, files.read_labelled(spark, folder, names).collect())) == [(False, 4.0, 0.0), (False, 4.0, 5.0), (True, 0.0, 3.0), (True, 1.0, 2.0)]


def test_decisions_round_trip_replaces_only_its_frames(spark, tmp_path):
    schema = "frame_idx int, group_id long, reason_kind string, reason_value double, will_paint boolean"
    first = [(0, 1, "userSelected", None, True), (0, 2, None, None, None), (1, 1, "fromClassifier", -0.5, False)]
    files.write_decisions(spark.createDataFrame(first, schema), f"{tmp_path}/d")
    files.write_decisions(spark.createDataFrame([(0, 3, "userSelected", None, False)], schema), f"{tmp_path}/d")
    assert sorted(map(tuple, files.read_decisions(spark, f"{tmp_path}/d").collect())) == [(0, 3, "userSelected", None, False), first[2]]
    labelled = files.label_features(spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0)], "frame_idx int, group_id long, size double"), spark.createDataFrame(first, schema))
    assert [tuple(r) for r in labelled.select("group_id", "label").collect()] == [(1, True)]


def test_settings_slices_and_manifests(spark, tmp_path):
    (tmp_path / "config.json").write_text('{"detectionType": "mild", "ignoreLowerPixels": 10}')
    assert files.read_config(spark, f"{tmp_path}/config.json") == {"detectionType": "mild", "ignoreLowerPixels": 10}
    folder = f"{tmp_path}/slices"
    assert files.read_slices(spark, folder).count() == 0
    rows = [(1, 1, 2, 3, 4, 5), (1, 2, 6, 7, 8, 9), (2, 1, 0, 0, 1, 1)]
    files.write_slices(spark.createDataFrame(rows, files.SLICES), folder)
    files.write_slices(spark.createDataFrame([(2, 1, 5, 5, 6, 6)], files.SLICES), folder)
    assert sorted(map(tuple, files.read_slices(spark, folder).collect())) == [*rows[:2], (2, 1, 5, 5, 6, 6)]
    (tmp_path / "good.json").write_text('{"/a": ["x", "y"], "/b": []}')
    (tmp_path / "bad.json").write_text('{"/a": ["x" "y"]}')
    assert sorted(map(tuple, files.read_manifest(spark, f"{tmp_path}/good.json").collect())) == [("/a", "x"), ("/a", "y")]
    assert files.read_manifest(spark, f"{tmp_path}/bad.json").count() == 0
    names = ("size", "width")
    for n in range(2):
        files.write_features(spark.createDataFrame([(n, 1.0, 2.0)], "group_id long, size double, width double"), f"{tmp_path}/f{n}", names)
    assert files.read_many_features(spark, [f"{tmp_path}/f0", f"{tmp_path}/f1"], names).count() == 2
