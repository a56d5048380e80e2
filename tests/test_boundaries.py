"""Exact small cases at the boundaries (handwritten rows)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import sequence as S
from quillspark.functions.labels import correct_rule, gen_method
from quillspark.functions.text import first_word, nonblank, py_strip, python_repr, space_pieces, tokens
from quillspark.operators import cohorts as A
from quillspark.operators import scoring as D
from quillspark.operators import tokens as TK
from quillspark.operators.joins import index_body
from quillspark.sources import readers as R
from quillspark.sources import sinks as K


def words(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.mark.parametrize("n", [0, 3, 4, 5, 6])
def test_special_pad_length_and_content(spark, n):
    max_len = 4
    df = spark.createDataFrame([(list(range(10, 10 + n)),)], "ids array<int>")
    out = df.select(S.special_pad("ids", max_len, 2, 3).alias("p")).first()["p"]
    head = list(range(10, 10 + min(n, max_len)))
    assert out == [2] + head + [3] + [0] * (max_len - len(head))
    assert len(out) == max_len + 2


@pytest.mark.parametrize("n,expected", [(0, [0]), (3, [3]), (4, [4]), (7, [4]), (8, [4, 4]), (9, [4, 4])])
def test_chunk_counts(spark, n, expected):
    df = spark.createDataFrame([(words(n),)], "text string")
    out = df.select(S.chunks(tokens("text"), 4).alias("c")).first()["c"]
    assert [len(c) for c in out] == expected
    flat = [t for c in out for t in c]
    assert flat == [f"w{i}" for i in range(len(flat))]  # chunks re-joined are a prefix of the text


def test_mask_prefix_ignores_special_tokens(spark):
    df = spark.createDataFrame([(2,), (4,), (9,)], "text_len int")
    got = [r["m"] for r in df.select(S.mask_prefix("text_len", 4).alias("m")).orderBy("text_len").collect()]
    assert got == [[1, 1, 0, 0, 0, 0], [1, 1, 1, 1, 0, 0], [1] * 6]


def test_tokenize_words_and_punctuation(spark):
    df = spark.createDataFrame([("Hello, World!  Ça  va?",)], "text string")
    assert df.select(tokens("text").alias("t")).first()["t"] == ["hello", ",", "world", "!", "ça", "va", "?"]


def test_space_pieces_python_split(spark):
    cases = ["", "a", "a b", "a  b", " a ", "\n"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r["n"] for r in df.select(space_pieces("t").alias("n")).collect()]
    assert got == [len(c.split(" ")) for c in cases]


def test_line_mode_counts_blank_lines(spark):
    text = "a b\n\n  \nc  d\n"
    df = spark.createDataFrame([("s", text)], "split string, text string")
    r = TK.line_mode_counts(df, "text", 256, ["split"]).first()
    py_lines = text.splitlines(keepends=True)
    assert r["n_original_tokens"] == sum(len(line.split(" ")) for line in py_lines)
    assert r["n_chunks"] == 2 and r["n_tokens"] == 4


def test_python_repr_matches_python(spark):
    cases = ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash", "tab\tnew\nline\rcr", "",
             "nbsp\xa0zero\u200bvt\x0bls\u2028", "\U000e0001 tag \U0001f600 face", "del\x7f \x85"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r["r"] for r in df.select(python_repr("t").alias("r")).collect()]
    assert got == [repr(c) for c in cases]


def test_first_word_blank_and_leading_space(spark):
    cases = ["  hello world", "   ", "", "\xa0nb\xa0sp", "\u2003\x1c\x85", "zero\u200bwidth x"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = df.select(first_word("t").alias("p"), nonblank("t").alias("nb"), py_strip("t").alias("s")).collect()
    assert [r["p"] for r in got] == [(c.split() or [""])[0] for c in cases]
    assert [r["nb"] for r in got] == [bool(c.strip()) for c in cases]
    assert [r["s"] for r in got] == [c.strip() for c in cases]


def test_correct_rule_tie_is_incorrect(spark):
    df = spark.createDataFrame([(0.5, 0.5, 1), (0.4, 0.6, 1), (0.6, 0.4, 0), (0.6, 0.4, 1)], "fake double, real double, label int")
    assert [r["c"] for r in df.select(correct_rule("fake", "real", "label").alias("c")).collect()] == [False, True, True, False]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.94,), (0.9400001,)], "real double")
    assert [r["correct"] for r in D.threshold(df, 0.94).collect()] == [False, True]


def test_last_write_keeps_last_occurrence(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.3), ("a", 2, 0.2), ("b", 1, 0.9)], "id string, o int, v double")
    got = {r["id"]: r["v"] for r in D.last_write(df, "id", "o", ["v"]).collect()}
    assert got == {"a": 0.3, "b": 0.9}


def test_above_mean_null_and_nan_are_false(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None), (4, float("nan"))], "k int, x double")
    got = {r["k"]: r["x_aboveavg"] for r in A.above_mean(df, "x").collect()}
    # mean over 1.0 and 3.0 only (NULL and NaN skipped) = 2.0
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_crosstab_absent_class_is_zero(spark):
    df = spark.createDataFrame([("high", 1), ("high", 1), ("low", 0)], "lvl string, correct int")
    got = {r["lvl"]: (r["correct_0"], r["correct_1"]) for r in A.crosstab(df, "lvl").collect()}
    assert got == {"high": (0, 2), "low": (1, 0)}


def test_gen_method_rejects_unknown(spark):
    df = spark.createDataFrame([(0.96, 0), (1.0, 0), (1.0, 40)], "p double, k int")
    assert [r["g"] for r in df.select(gen_method(F.lit("m"), "p", "k").alias("g")).collect()] == ["m_p96", "m_p100", "m_k40"]
    bad = spark.createDataFrame([(0.5, 3)], "p double, k int")
    with pytest.raises(Exception, match="unknown decode setting"):
        bad.select(gen_method(F.lit("m"), "p", "k")).collect()


def test_missing_body_is_an_error(spark):
    idx = spark.createDataFrame([("a",), ("b",)], "filename string")
    bodies = spark.createDataFrame([("a", "text")], "filename string, text string")
    with pytest.raises(Exception, match="no body for filename=b"):
        index_body(idx, bodies).collect()
    with pytest.raises(Exception, match="no body for filename=b"):
        index_body(idx, bodies).select("filename").collect()
    empty = spark.createDataFrame([("a", None), ("b", "x")], "filename string, text string")
    assert {r["filename"]: r["text"] for r in index_body(idx, empty).collect()} == {"a": None, "b": "x"}


def test_split_compares_with_one_bound(spark):
    """Ranking by hash and comparing with the row at the cut agree; odd ids and tiny tables are defined."""
    from quillspark.operators.sampling import shuffle_split

    df = spark.range(101).select(F.col("id").alias("k"), F.lit("text").alias("text"))
    got = {r["k"]: r["split"] for r in shuffle_split(df, "k", 0.9).collect()}
    order = sorted(got, key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert [got[k] for k in order] == ["train"] * 90 + ["valid"] * 11
    assert shuffle_split(df.limit(0), "k", 0.9).collect() == []
    odd = spark.createDataFrame([(None,), (None,), (1,), (1,)], "k long")
    assert {r["split"] for r in shuffle_split(odd, "k", 1.0).collect()} == {"train"}
    half = shuffle_split(odd, "k", 0.5).collect()
    assert sorted((r["k"] is None, r["split"]) for r in half) == [(False, "valid")] * 2 + [(True, "train")] * 2


def test_unknown_extension_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        K.save(df, str(tmp_path / "out.pkl"))
    with pytest.raises(ValueError):
        R.load(spark, str(tmp_path / "in.html"))
    with pytest.raises(ValueError):
        R.load(spark, str(tmp_path / "in.json"))


@pytest.mark.parametrize("ext", ["parquet", "json", "csv"])
def test_dispatch_round_trip_keeps_texts(spark, tmp_path, ext):
    df = spark.createDataFrame([(1, "  spaced  "), (2, 'quo"te, comma'), (3, "line\r\nline"), (4, None)], "k int, text string")
    path = str(tmp_path / f"t.{ext}")
    K.save(df, path)
    assert sorted(R.load(spark, path, df.schema).collect()) == sorted(df.collect())


def test_running_sum_over_null_and_wide_groups(spark):
    """Groups are told apart exactly: null is a group of its own, and near-equal large longs differ."""
    from quillspark.operators.indexing import with_row_index

    rows = [(g, k, 1) for g in (None, 2**60, 2**60 + 1) for k in range(5)]
    df = spark.createDataFrame(rows, "g long, k int, v int")
    got = with_row_index(df, ["k"], ["g"], cum_of="v", num_partitions=4).collect()
    assert {(r["g"], r["k"]): (r["row_idx"], r["cum_before"]) for r in got} == {(g, k): (k, k) for g, k, _ in rows}


def test_csv_reader_quotes_commas_newlines(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('url,review_text,x\nu1,"a, b",1.5\nu2,"say ""hi""\nnext line",\n')
    df = R.read_reviews_csv(spark, str(p), "url string, review_text string, x double")
    rows = {r["url"]: (r["review_text"], r["x"]) for r in df.collect()}
    assert rows == {"u1": ("a, b", 1.5), "u2": ('say "hi"\nnext line', None)}


def test_whole_text_reader_keeps_newlines(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"e{i}.txt").write_text(f"line one {i}\nline two\n")
    df = R.read_whole_texts(spark, str(tmp_path), glob="*.txt")
    got = {r["file_name"]: r["text"] for r in df.collect()}
    assert got == {f"e{i}.txt": f"line one {i}\nline two\n" for i in range(3)}


def test_skip_tokens_returns_raw_text(spark):
    from quillspark.plans.detector import essay_dataset

    raw = essay_dataset(spark, "/root/testdata/sf0.001", skip_tokens=True)
    full = essay_dataset(spark, "/root/testdata/sf0.001")
    assert raw.count() >= full.count() > 0
    r = full.first()
    assert len(r["token_ids"]) == 130 and r["mask"] == [1] * 130
    assert raw.filter(F.size("token_ids") > 0).count() == 0


def test_position_split_keeps_the_rest(spark):
    from quillspark.operators.sampling import position_split

    got = {r.k: r.split for r in position_split(spark.range(6).toDF("k"), ["k"], (2, 3, 4)).collect()}
    assert got == {0: "train", 1: "train", 2: "valid", 3: "test", 4: "unused", 5: "unused"}


def test_batch_cap_keeps_the_text_that_overshoots(spark):
    from quillspark.operators.tokens import capped_texts

    rows = [("a", 0, 2), ("a", 1, 4), ("a", 2, 1), ("b", 0, 9), ("b", 1, 1)]
    df = spark.createDataFrame([(p, i, [[0]] * n) for p, i, n in rows], "path string, idx long, chunks array<array<int>>")
    got = {(r.path, r.idx) for r in capped_texts(df, "path", "idx", "chunks", 3).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 0)}


def test_corpus_counts_in_one_pass_equal_those_by_mode(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import tokens as TK

    texts = ["", " ", "one two three", "a\r\nb c\rd\n\n", "x " * 17 + "\n" + "y z " * 9, "\n\n", "w v\x0bu\x85t\x1cs", "it's 1.5\n" * 4, None]
    df = spark.createDataFrame([("ab"[i % 2], t) for i, t in enumerate(texts * 2)], "split string, text string")
    one = {(r["split"], r["mode"]): tuple(r)[2:] for r in TK.all_mode_counts(df, "text", 4, ["split"]).collect()}
    own = df.filter(F.col("text").isNotNull())
    for mode, counts in (
        ("whole", TK.whole_mode_counts(own, "text", 4, ["split"])),
        ("line", TK.line_mode_counts(own, "text", 4, ["split"])),
        ("fast", TK.line_mode_counts(own, "text", 4, ["split"], fast=True)),
    ):
        for r in counts.collect():
            assert one[r["split"], mode] == tuple(r)[1:], mode
    assert len(one) == 6
