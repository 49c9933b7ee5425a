"""Files: frames, catalogs, annotations, archives and writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.sources import episodes as Ep, npz, sinks


def test_dataset_folder(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("frame_index"), F.lit(1.0).alias("timestamp"), F.lit("x").alias("unused")).coalesce(1).write.parquet(
        str(tmp_path / "data/chunk-000/episode_000007.parquet"))
    got = Ep.read_frames(spark, str(tmp_path / "data"), ["frame_index", "timestamp"])
    assert {r.episode_index for r in got.collect()} == {7} and "unused" not in got.columns
    (tmp_path / "episodes.jsonl").write_text('{"episode_index": 7, "length": 3}\n{"episode_index": 8, "length": 2}\n')
    gaps = Ep.catalog_gaps(Ep.read_episode_catalog(spark, str(tmp_path / "episodes.jsonl")), got, "episode_index").collect()
    assert [r.episode_index for r in gaps] == [8]
    (tmp_path / "info.json").write_text(json.dumps({"fps": 30, "total_episodes": 2, "features": {"state": {"dtype": "float32", "shape": [12]}}}, indent=1))
    info = Ep.read_dataset_info(spark, str(tmp_path / "info.json")).first()
    assert info.fps == 30 and info.features["state"].shape == [12]


def test_annotations(spark, tmp_path):
    doc = {"category_id": "pants", "template_status": "manually_annotated", "segments": [
        {"segment_id": 0, "label": "a", "start_frame": 0, "end_frame_exclusive": 2, "end_frame_inclusive": 1, "num_frames": 2,
         "progress": {"method": "m", "per_frame": [{"frame": 0, "progress": 0.0}, {"frame": 1, "progress": 1.0}]}}]}
    for e, text in ((3, json.dumps(doc, indent=2)), (4, "{broken"), (5, json.dumps({**doc, "template_status": "draft"})), (6, json.dumps({**doc, "segments": []}))):
        folder = tmp_path / f"episode_{e:06d}"
        folder.mkdir()
        (folder / "checkpoints.json").write_text(text)
    segments, skipped = Ep.read_annotations(spark, str(tmp_path), "manually_annotated")
    assert [(r.episode, r.label) for r in segments.collect()] == [(3, "a")]
    assert [(r.frame, r.progress) for r in Ep.per_frame_labels(segments).orderBy("frame").collect()] == [(0, 0.0), (1, 1.0)]
    assert sorted(r.problem for r in skipped.collect()) == ["no_segments", "other_status", "unreadable"]


def test_npz_archives(spark, tmp_path):
    np.savez(tmp_path / "episode_000001.npz", vec=np.arange(6.0).reshape(3, 2), frame_indices=np.arange(3))
    np.savez(tmp_path / "episode_000002.npz", other=np.zeros(2))
    np.savez(tmp_path / "episode_000003.npz", vec=np.array([[np.nan, 1.0]]))
    np.savez(tmp_path / "episode_000004.npz", vec=np.ones((2, 2)), frame_indices=np.array([0, 2]))
    rows = npz.ingest_npz(spark, str(tmp_path)).collect()
    assert sorted(r.problem for r in rows if r.problem) == ["frames not contiguous", "missing key", "non-finite values"]
    assert [r.vec for r in sorted((r for r in rows if r.episode == 1), key=lambda r: r.frame)] == [[0, 1], [2, 3], [4, 5]]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, s string, extra long")
    sinks.write_csv(df, str(tmp_path / "csv"), ["s", "id"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["s", "id"]
    sinks.write_jsonl(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    out = str(tmp_path / "episodes")
    sinks.write_episodes(df, out, False, ["s"])
    with pytest.raises(Exception):
        sinks.write_episodes(df, out, False, ["s"])
    sinks.write_episodes(df.where("id = 1").withColumn("extra", F.lit(9).cast("long")), out, True, ["s"])
    assert {(r.id, r.extra) for r in spark.read.parquet(out).collect()} == {(1, 9), (2, 6)}


def test_committed_episodes_survive_a_failed_run(spark, tmp_path):
    out = str(tmp_path / "episodes")
    rows = lambda *ids: spark.createDataFrame([(i, i * 2) for i in ids], "id long, x long")
    ids = lambda: sorted(r.id for r in sinks.read_committed(spark, out).collect())
    with pytest.raises(ValueError):
        sinks.read_committed(spark, out)
    assert sinks.commit_episodes(rows(1, 2), out) == 1 and ids() == [1, 2]
    with pytest.raises(ValueError):
        sinks.commit_episodes(rows(9), out)
    broken = spark.range(100, numPartitions=4).select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("a task fails")).cast("long")).otherwise(F.col("id")).alias("x"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="a task fails"):
            sinks.commit_episodes(broken, out, mode)
        assert ids() == [1, 2]
    assert sinks.commit_episodes(rows(3).withColumn("y", F.lit(1)), out, "append") == 2 and ids() == [1, 2, 3]
    assert sinks.commit_episodes(rows(7), out, "overwrite") == 3 and ids() == [7]
    (tmp_path / "episodes" / "commits" / "0000000004").mkdir()  # another writer has taken the next number
    with pytest.raises(Exception, match="exist"):
        sinks.commit_episodes(rows(8), out, "overwrite")
    assert ids() == [7]


def test_file_list(spark, tmp_path):
    for name in ("a.txt", "sub/b.txt", ".cache/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("12345")
    assert {(r.path, r.size) for r in Ep.scan_files(spark, str(tmp_path)).collect()} == {("a.txt", 5), ("sub/b.txt", 5)}
