"""Reader / writer properties the value oracle cannot see: ordering, layout, pruning, aliases."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from quillspark.sources import readers as R
from quillspark.sources import sinks as K


def test_result_sink_sorted_across_and_within_files(spark, tmp_path):
    df = spark.range(500).select(F.format_string("id%04d", (F.col("id") * 7919) % 500).alias("id"),
                                 F.rand(1).alias("real"))
    out = tmp_path / "res"
    K.write_results(df, str(out))
    ids = []
    for f in sorted(Path(out).glob("part-*.json")):
        ids += [json.loads(line)["id"] for line in f.read_text().splitlines()]
    assert ids == sorted(ids) and len(ids) == 500


def test_shard_layout_and_partition_pruning(spark, tmp_path):
    rows = [(f"p{i}", f"text {i}", "gpt2_p96" if i % 2 else "gpt2_k40", "valid" if i % 3 == 0 else "train", i)
            for i in range(30)]
    df = spark.createDataFrame(rows, "id string, text string, gen_method string, split string, row_idx long")
    root = tmp_path / "shards"
    K.write_generated_shards(df, str(root), shard_size=10)
    dirs = {str(p.relative_to(root)) for p in root.glob("gen_method=*/split=*/shard=*")}
    assert "gen_method=gpt2_p96/split=valid/shard=0" in dirs and len(dirs) <= 12
    valid = R.read_generated(spark, str(root), "valid")
    plan = spark._jvm.PythonSQLUtils.explainString(valid._jdf.queryExecution(), "formatted")
    assert any("PartitionFilters" in line and "= valid)" in line for line in plan.splitlines())
    assert sorted(r["id"] for r in valid.collect()) == sorted(f"p{i}" for i in range(30) if i % 3 == 0)
    assert valid.count() == R.read_generated(spark, str(root), "val", prefix=True).count()


def test_small_shards_share_folders(spark, tmp_path):
    """The files do not follow the shards, every record keeps its shard, and a file has its records in order."""
    rows = [(f"p{i}", f"line\n{i}", ("gpt2_p96", "gpt2_k40", None)[i % 3], ("valid", "train")[i % 2], i) for i in range(-7, 12_000, 7)]
    rows += [("none", None, "gpt2_k40", "train", None)] + rows[-3:]
    df = spark.createDataFrame(rows, "id string, text string, gen_method string, split string, row_idx long").repartition(2)
    want = sorted(((i, t, g, s, None if k is None else k // 10) for i, t, g, s, k in rows), key=str)
    root, whole = tmp_path / "small", tmp_path / "whole"
    K.write_generated_shards(df, str(root), shard_size=10)
    files = list(root.glob("gen_method=*/split=*/shard=*/*.json"))
    assert {p.parent.name for p in files} == {"shard=-1000", "shard=0", "shard=1000", "shard=__HIVE_DEFAULT_PARTITION__"} and len(files) <= 2 * 19
    for p in files:
        at = [int(json.loads(x)["id"][1:]) for x in p.read_text().splitlines() if '"none"' not in x]
        assert at == sorted(at)
    assert sorted((tuple(r) for r in R.read_generated(spark, str(root)).collect()), key=str) == want
    # shards of the full size have a folder each
    K.write_generated_shards(df, str(whole))
    assert {p.name for p in whole.glob("gen_method=*/split=*/shard=*")} == {"shard=-1", "shard=0", "shard=1", "shard=__HIVE_DEFAULT_PARTITION__"}
    assert sorted((r["id"], r["shard"]) for r in R.read_generated(spark, str(whole)).collect() if r["shard"] is not None) == sorted((r[0], r[4] // K.SHARD_SIZE) for r in rows if r[4] is not None)


def test_news_reader_maps_valid_to_val(spark, tmp_path):
    p = tmp_path / "news.jsonl"
    p.write_text("\n".join(json.dumps({"url": f"u{i}", "split": s, "article": "a", "label": "human"})
                           for i, s in enumerate(["train", "val", "test", "val"])) + "\n")
    got = sorted(r["url"] for r in R.read_news(spark, str(p), "valid").collect())
    assert got == ["u1", "u3"]


def test_json_array_positions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(["first", "se,cond", "third\nline"]))
    got = [(r["idx"], r["text"]) for r in R.read_json_arrays(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == [(0, "first"), (1, "se,cond"), (2, "third\nline")]


def test_metric_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for epoch in range(3):
        K.append_metrics(spark.createDataFrame([(epoch, 1.0 / (epoch + 1))], "epoch long, val_loss double"), path)
    assert sorted(r["epoch"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_containers_are_bounded_and_round_trip(spark, tmp_path):
    """Texts and arrays come back as written; no stored value is above the bound and the file count does not follow the texts."""
    texts = [("a", "short"), ("b", ""), ("c", "line\r\nline\u2028\"q\" \\\\ " * 40), ("d", "é日😀" * 100), ("e", None)] + [(f"n{i}", f"text {i}") for i in range(200)]
    K.write_members(spark.createDataFrame(texts, "name string, text string").coalesce(2), str(tmp_path / "m"), "name", part_chars=50)
    parts = R.read_members(spark, str(tmp_path / "m"), parts=True).collect()
    assert max(len(r["text"]) for r in parts) <= 50 and len(list((tmp_path / "m").glob("part-*"))) <= 2
    assert {r["name"]: r["text"] for r in R.read_members(spark, str(tmp_path / "m")).collect()} == {n: t for n, t in texts if t is not None}
    rows = [(k, i, f"{k}-{i}\n\"x\"") for k, n in ((1, 1), (2, 1300), (3, 7)) for i in range(n)]
    K.write_array_parts(spark.createDataFrame(rows, "k long, idx long, text string"), str(tmp_path / "a"), ["k"], "idx", part_items=100)
    back = R.read_array_parts(spark, str(tmp_path / "a"), "k long")
    assert sorted(map(tuple, back.collect())) == rows
    stored = spark.read.json(str(tmp_path / "a"))
    assert stored.count() == 1 + 13 + 1


def test_union_of_origins_wants_equal_columns(spark):
    import pytest

    from quillspark.operators.joins import union_origins

    with pytest.raises(Exception, match="column"):
        union_origins(spark.range(1).toDF("a"), spark.range(1).toDF("b"))
