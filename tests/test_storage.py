from __future__ import annotations

from types import SimpleNamespace

import pytest

from partmill.sources import blobs, storage


def test_paths_without_a_scheme_are_resolved_as_spark_does(spark, tmp_path):
    assert storage.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    with blobs.create(f"file:{tmp_path}/a/b.bin") as file:
        file.write(b"xyz")
    assert spark.read.format("binaryFile").load(f"{tmp_path}/a").first()["content"] == b"xyz"
    with pytest.raises(ValueError):
        blobs.open_store(str(tmp_path))


def test_a_cluster_must_name_its_shared_folder():
    nothing = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="local-cluster[3,2,1024]"))
    with pytest.raises(ValueError):
        storage.shared_dir(nothing)


def test_a_table_kept_in_the_shared_folder(spark):
    kept = storage.materialize(spark.range(5), "five")
    assert kept.count() == 5 and kept.inputFiles()[0].startswith("file:")
