"""Rows-only jobs: detector training/scoring, generation and resumable streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.operators import detector as DT
from quillspark.operators.scoring import lexical_logits
from quillspark.session import scratch_path
from quillspark.streaming.incremental import ledger, run_incremental, scored_batches

SF = "/root/testdata/sf0.001"


def test_streaming_resumes_and_equals_batch(spark):
    base = scratch_path(spark, "test-stream")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.filter(F.col("doc_id") % 3 != 2).write.parquet(f"{base}/in/drop=0")
    args = (f"{base}/in/*", "doc_id long, text string", f"{base}/out", f"{base}/ckpt")
    first = run_incremental(spark, *args)
    assert first == scored_batches(spark, f"{base}/out").count() > 0
    assert run_incremental(spark, *args) == 0  # nothing new: nothing is scored twice
    docs.filter(F.col("doc_id") % 3 == 2).write.parquet(f"{base}/in/drop=1")
    assert run_incremental(spark, *args) == docs.count() - first
    assert ledger(spark, f"{base}/ckpt").agg(F.sum("rows")).first()[0] == docs.count()
    out = scored_batches(spark, f"{base}/out")
    batch = lexical_logits(docs.select("doc_id", tokens("text").alias("tokens"))).select("doc_id", "l_fake", "l_real")
    assert out.count() == docs.count() > first
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_train_detector_picks_one_best(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    conv = spark.read.parquet(f"{SF}/conversations.parquet").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    rows = docs.withColumn("label", F.lit(1)).unionByName(conv.withColumn("label", F.lit(0)))
    rows = DT.hash_split(rows.withColumn("tokens", tokens("text")))
    model, metrics = DT.train_detector(rows.filter("split = 'train'"), rows.filter("split = 'valid'"), grid=(0.0, 0.1))
    m = metrics.collect()
    assert len(m) == 2 and sum(r["best"] for r in m) == 1
    scored = DT.score_detector(model, rows, "id").collect()
    assert len(scored) == rows.count()
    assert all(abs(r["fake"] + r["real"] - 1) < 1e-9 for r in scored)


def test_count_detector_scores_rows_that_chose_nothing(spark):
    import math

    texts = ["a b c", "a b", "a c c", "x y", "x z", "y z z", "a x", "", "q"]
    rows = spark.createDataFrame([(str(i), int(i < 3 or i == 6), t.split()) for i, t in enumerate(texts)], "id string, label int, tokens array<string>")
    model = DT.fit_counts(rows)
    got = {r["id"]: r["l_1"] for r in DT.count_logits(model, rows, (0.1, 2.0)).collect()}
    held = {y: {} for y in (0, 1)}
    for r in rows.collect():
        for t in set(r["tokens"]):
            held[r["label"]][t] = held[r["label"]].get(t, 0) + 1
    v, total = len(set(held[0]) | set(held[1])), {y: sum(held[y].values()) for y in (0, 1)}
    for i, t in enumerate(texts):
        want = math.log(5 / 6) + sum(math.log((held[1].get(w, 0) + 2) / (total[1] + 2 * (v + 1))) - math.log((held[0].get(w, 0) + 2) / (total[0] + 2 * (v + 1))) for w in set(t.split()))
        assert abs(got[str(i)] - want) < 1e-12
    m = DT.choose_smoothing(model, rows, (0.1, 2.0)).collect()
    assert sum(r["best"] for r in m) == 1 and all(0 <= r["valid_acc"] <= 1 for r in m)
    scored = DT.score_counts(model, rows, 2.0).collect()
    assert len(scored) == len(texts) and all(abs(r["fake"] + r["real"] - 1) < 1e-12 for r in scored)


def test_three_way_split_keeps_copies_together(spark):
    rows = spark.createDataFrame([(i, f"Text  {i % 40}" if i % 2 else f"text {i % 40} ") for i in range(400)] + [(400, None)], "id long, text string")
    s = DT.hash_split(rows, test_below="3", valid_below="6")
    assert {r["split"] for r in s.collect()} == {"train", "valid", "test"}
    assert s.groupBy(F.regexp_replace(F.lower(F.trim("text")), " +", " ")).agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_user_scorer_path(spark):
    df = spark.createDataFrame([("a", 1, "x y z"), ("b", 0, "p")], "id string, label int, text string")
    out = DT.score_with(df, lambda s: np.stack([np.zeros(len(s)), s.str.len().to_numpy() - 2.0], axis=1)).collect()
    got = {r["id"]: (round(r["real"], 6), r["correct"]) for r in out}
    assert got == {"a": (round(1 / (1 + np.exp(-3.0)), 6), True), "b": (round(1 / (1 + np.exp(1.0)), 6), True)}


def test_queries_run_outside_the_repo_directory(tmp_path):
    """Python-worker kernels must not depend on the package being importable on the executors."""
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(__file__).resolve().parents[1])
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['M4_generate'](s, %r).count())\n" % (repo, SF)
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "ROWS " in out.stdout and int(out.stdout.split("ROWS ")[1].split()[0]) > 0


def test_incremental_count_past_the_progress_window(spark, tmp_path):
    from quillspark.streaming.incremental import run_incremental

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(i, "some words here") for i in range(110)], "doc_id long, text string").repartition(110).write.parquet(src)
    files = len([f for f in (tmp_path / "in").iterdir() if f.name.startswith("part-")])
    assert run_incremental(spark, src, "doc_id long, text string", out, ck, files_per_batch=max(1, files // 105)) == 110
    assert run_incremental(spark, src, "doc_id long, text string", out, ck) == 0


def test_incremental_restart_in_the_middle_of_a_run(spark, tmp_path, monkeypatch):
    """A run that fails after a batch was written, before it was committed: the next one writes that batch again, once."""
    import quillspark.streaming.incremental as I

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for drop in range(3):
        spark.createDataFrame([(10 * drop + i, f"words of {drop} {i}") for i in range(drop + 2)], "doc_id long, text string").coalesce(1).write.parquet(f"{src}/drop={drop}")
    args = (f"{src}/*", "doc_id long, text string", out, ck)
    path, calls = I.ledger_path, []

    def broken(checkpoint_dir):  # asked for the place of the second batch's count, after its rows were written
        calls.append(checkpoint_dir)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return path(checkpoint_dir)

    monkeypatch.setattr(I, "ledger_path", broken)
    with pytest.raises(Exception, match="lost"):
        run_incremental(spark, *args, files_per_batch=1)
    monkeypatch.undo()
    done = ledger(spark, ck).agg(F.sum("rows")).first()[0]
    assert 0 < done < 9
    assert run_incremental(spark, *args, files_per_batch=1) == 9 - done
    assert sorted(r["doc_id"] for r in scored_batches(spark, out).collect()) == [0, 1, 10, 11, 12, 20, 21, 22, 23]
    assert ledger(spark, ck).agg(F.sum("rows"), F.count("*")).first() == (9, 3)


def test_training_log_of_shares(spark, tmp_path):
    """Each epoch's model equals a fit of the shares so far; a run that breaks goes on where the log ends, and a logged epoch stays."""
    from quillspark.operators import ngram as M
    from quillspark.operators.training_log import log_epochs, logged_epochs, model_after, write_share_counts

    counts, log = str(tmp_path / "counts"), str(tmp_path / "log")
    rows = [(i, i % 3, ["the", f"w{i % 5}", "the", f"w{i % 7}"][: i % 4 + 1]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, share int, chunk array<string>")
    write_share_counts(d.filter("share < 2"), counts)
    write_share_counts(d.filter("share = 2").repartition(5), counts)
    held = M.pair_counts(d.filter("doc_id < 7"), ("doc_id",), out="m")

    def table_of(model):
        return sorted(map(tuple, model.bigrams.select("ctx", "tok", "n", "ctx_n").collect()))

    for e in range(3):
        assert table_of(model_after(spark, counts, e)) == table_of(M.fit(d.filter(F.col("share") <= e)))
    calls = []

    def evaluate(model):
        calls.append(model.total)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return M.pair_losses(model, held, ("doc_id",)).agg(F.sum("loss_sum").alias("loss"), F.sum("n_tokens").alias("n"))

    assert logged_epochs(spark, log) == set()
    with pytest.raises(RuntimeError, match="lost"):
        log_epochs(spark, counts, 3, evaluate, log)
    assert logged_epochs(spark, log) == {0}
    log_epochs(spark, counts, 3, evaluate, log)
    log_epochs(spark, counts, 3, evaluate, log)
    assert len(calls) == 4 and calls[1] == calls[2]
    got = {r["epoch"]: (r["loss"], r["n"]) for r in spark.read.parquet(log).collect()}
    for e in range(3):
        want = M.chunk_losses(M.fit(d.filter(F.col("share") <= e)), d.filter("doc_id < 7"), ("doc_id",)).agg(F.sum("loss_sum"), F.sum("n_tokens")).first()
        assert abs(got[e][0] - want[0]) < 1e-9 and got[e][1] == want[1]


def test_every_drop_is_one_batch_however_many_files(spark, tmp_path, monkeypatch):
    from quillspark.plans import q_ml
    from quillspark.streaming.incremental import ledger

    spark.range(40).selectExpr("id as doc_id", "concat('a b ', id) as text").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(q_ml, "scratch_path", lambda spark, name: str(tmp_path / name))
    assert q_ml.q_d11(spark, str(tmp_path)).count() == 40
    rows = ledger(spark, str(tmp_path / "stream" / "ckpt")).collect()
    assert sorted((r["batch_id"], r["rows"]) for r in rows) == [(0, 14), (1, 13), (2, 13)]


def test_detector_corpus_is_hashed_and_tokenized_once(spark, tmp_path, monkeypatch):
    """The splits are read from what was written, a folder each; no text is tokenized again."""
    from quillspark.plans import q_ml

    rows = spark.createDataFrame([(str(i), i % 2, f"w{i % 7} common w{i % 7}") for i in range(60)] + [("n", 1, None)], "id string, label int, text string")
    monkeypatch.setattr(q_ml, "labelled", lambda spark, sf_dir: rows)
    c, model, metrics = q_ml.fitted(spark, "")
    plan = c.filter("split = 'test'")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "PartitionFilters: [isnotnull(split" in plan
    assert c.count() == 61 and metrics.count() == 3
