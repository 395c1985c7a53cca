import os
from types import SimpleNamespace

import pytest

from tastegraph.plans import catalog
from tastegraph.sources import readers, writers


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_repeated_header_goes_everywhere(spark, folder):
    path = os.path.join(folder, "r.csv")
    with open(path, "w") as f:
        f.write("u,b,s\nu1,b1,4.0\nu,b,s\nu2,b2,3\n")
    rows = sorted(map(tuple, readers.read_ratings(spark, path, "u,b,s").collect()))
    assert rows == [("u1", "b1", 4.0), ("u2", "b2", 3.0)]
    assert sorted(map(tuple, readers.read_pairs(spark, path, "u,b,s").collect())) == [
        ("u1", "b1"), ("u2", "b2")
    ]
    with pytest.raises(ValueError, match="no header line"):
        readers.read_ratings(spark, path)


def test_a_file_without_header_next_to_one_with_it_loses_nothing(spark, folder):
    lines = [f"u{i},b{i}\n" for i in range(199)] + ["u0,b0\n"]
    with open(os.path.join(folder, "part-0.csv"), "w") as f:
        f.writelines(["user_id,business_id\n", *lines[:20]])
    with open(os.path.join(folder, "part-1.csv"), "w") as f:
        f.writelines(lines[20:])
    rows = readers.read_pairs(spark, folder).collect()
    assert sorted(f"{u},{b}\n" for u, b in rows) == sorted(lines)


def test_empty_file_has_no_rows(spark, folder):
    path = os.path.join(folder, "empty.csv")
    open(path, "w").close()
    assert readers.read_pairs(spark, path).count() == 0


def test_header_in_every_file(spark, folder):
    for name in ("a", "b"):
        with open(os.path.join(folder, name + ".csv"), "w") as f:
            f.write(f"user_id,business_id,stars\nu{name},b{name},1\n")
    assert readers.read_ratings(spark, folder).count() == 2


def test_business_missing_and_null_categories(spark, folder):
    path = os.path.join(folder, "business.json")
    with open(path, "w") as f:
        f.write('{"business_id": "b1", "review_count": 3, "stars": 4.5, "city": "X", '
                '"is_open": 1, "categories": null, "extra": {"a": 1}}\n')
        f.write('{"business_id": "b2", "review_count": 1, "stars": 2.0, "city": "Y", '
                '"is_open": 0, "categories": ""}\n')
    rows = {r["business_id"]: r for r in readers.read_business(spark, path).collect()}
    assert rows["b1"]["categories"] is None and rows["b2"]["categories"] == ""
    assert rows["b1"]["stars"] == 4.5 and "extra" not in rows["b1"].asDict()


def test_edges_round_trip_with_extra_blanks(spark, folder):
    path = os.path.join(folder, "edges.txt")
    with open(path, "w") as f:
        f.write("a b\n c\td \n\n")
    assert sorted(map(tuple, readers.read_edges(spark, path).collect())) == [
        ("a", "b"), ("c", "d")
    ]


def test_vectors_round_trip(spark, folder):
    path = os.path.join(folder, "v")
    df = spark.createDataFrame([("x", [1.5, -2.0]), ("y", [0.0, 3.25])], "id string, embedding array<float>")
    writers.write_vectors(df, path, 2)
    assert sorted(map(tuple, readers.read_vectors(spark, path, 2).collect())) == [
        ("x", [1.5, -2.0]), ("y", [0.0, 3.25])
    ]


def test_broken_json_line_raises(spark, folder):
    path = os.path.join(folder, "photo.json")
    with open(path, "w") as f:
        f.write('{"business_id": "b1", "photo_id": "p", "label": "food"}\n{"business_id": "b2", \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_photo(spark, path).collect()


def test_scratch_folder_is_the_one_the_cluster_names():
    from types import SimpleNamespace

    from tastegraph.session import scratch_root

    def session(settings, master="spark://x", own=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda name, default: settings.get(name, default)),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: own),
        )

    assert scratch_root(session({"spark.checkpoint.dir": "hdfs://n/x"})) == "hdfs://n/x"
    assert scratch_root(session({}, own="hdfs://n/own")) == "hdfs://n/own"
    for settings in ({}, {"spark.checkpoint.dir": "file:/tmp/x"}):
        with pytest.raises(ValueError):
            scratch_root(session(settings))


def test_jobs_side_by_side_keep_their_files(spark):
    import threading

    from tastegraph.session import materialise, temporary_scratch

    written, ended, rows = threading.Event(), threading.Event(), []

    def longer():
        with temporary_scratch(spark):
            df = materialise(spark.range(5), "longer")
            written.set()
            ended.wait(60)
            rows.append(df.count())

    job = threading.Thread(target=longer)
    job.start()
    assert written.wait(60)
    with temporary_scratch(spark):
        materialise(spark.range(2), "shorter")
    ended.set()
    job.join()
    assert rows == [5]


def test_scratch_is_dropped(spark):
    from tastegraph.session import drop_scratch, materialise

    df = materialise(spark.range(3), "x")
    assert df.count() == 3
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    drop_scratch(spark)
    assert not os.path.exists(path)


def test_parts_of_pairs_are_written_by_many_tasks(fx):
    table = SimpleNamespace(spark=fx.spark, pairs=fx.pairs.repartition(3))
    found = catalog.read_pairs_parts(table)
    assert len(found.inputFiles()) >= 4
    assert found.count() == fx.pairs.count()
