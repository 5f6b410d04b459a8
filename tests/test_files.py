from lecturelake.sources import files


def test_candidates_that_are_missing_broken_or_empty(spark, tmp_path):
    (tmp_path / "a.json").write_text("not json\n")
    (tmp_path / "b.json").write_text('{"k": 1}\nbroken\n')
    at = [str(tmp_path / n) for n in ("none.json", "a.json", "b.json")]
    assert [r.k for r in files.read_optional(spark, at, "k long").collect()] == [1]
    assert files.read_optional(spark, at[:1], "k long").collect() == []


def test_objects_and_arrays_and_the_last_path(spark, tmp_path):
    (tmp_path / "a_metadata.json").write_text('[{"id": "x", "v": 1},\n {"id": "y", "v": 2}, {"v": 9}]')
    (tmp_path / "b_metadata.json").write_text('{"id": "y",\n "v": 3}')
    rows = files.read_latest(spark, f"{tmp_path}/*_metadata*.json", "id string, v long", "id", multi_line=True)
    assert sorted(map(tuple, rows.collect())) == [("x", 1), ("y", 3)]


def test_silences_without_partners_or_length_go(spark):
    lines = ["silence_start: 1.5", "noise", "silence_end: 3.0 | silence_duration: 1.5", "silence_start: 5", "silence_end: 5 | silence_duration: 0", "silence_start: 8"]
    log = spark.createDataFrame([("r", i, x) for i, x in enumerate([*lines, None])], "recording string, place long, line string")
    assert [tuple(r) for r in files.silences(log, "recording", "line", "place").collect()] == [("r", 1.5, 3.0, 1.5)]
