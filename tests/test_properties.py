"""Properties: partition independence, exactness against brute force, equal alternative paths."""

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions.sequence import chunks
from quillspark.functions.text import tokens
from quillspark.operators import cohorts as A
from quillspark.operators import generate as G
from quillspark.operators import indexing as IX
from quillspark.operators import ngram as M
from quillspark.operators import packed as P
from quillspark.operators import sampling as L
from quillspark.operators import tokens as TK


def skewed(spark, n=400):
    # group "hot" holds most rows; order key unique within each group
    rows = [("hot" if i % 5 else f"g{i % 3}", i, i % 7) for i in range(n)]
    return spark.createDataFrame(rows, "g string, k int, v int")


@pytest.mark.parametrize("parts", [1, 5])
def test_row_index_equals_global_row_number(spark, parts):
    df = skewed(spark)
    got = IX.with_row_index(df, ["k"], ["g"], cum_of="v", num_partitions=parts)
    w = Window.partitionBy("g").orderBy("k")
    ref = df.select("g", "k", (F.row_number().over(w) - 1).alias("row_idx"),
                    F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cum_before"))
    a = sorted(tuple(r) for r in got.select("g", "k", "row_idx", "cum_before").collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_row_index_shuffle_join_path(spark, monkeypatch):
    monkeypatch.setattr(IX, "OFFSETS_BROADCAST_ROWS", 0)
    df = skewed(spark, 100)
    got = sorted(tuple(r) for r in IX.with_row_index(df, ["k"], ["g"], num_partitions=3).select("g", "k", "row_idx").collect())
    exp = {}
    ref = []
    for g, k, _ in sorted((r["g"], r["k"], 0) for r in df.collect()):
        ref.append((g, k, exp.setdefault(g, 0)))
        exp[g] += 1
    assert got == ref


def test_shuffle_split_exact_and_disjoint(spark):
    df = spark.range(101).withColumnRenamed("id", "doc_id")
    s = L.shuffle_split(df, "doc_id", 0.9).collect()
    train = {r["doc_id"] for r in s if r["split"] == "train"}
    valid = {r["doc_id"] for r in s if r["split"] == "valid"}
    assert len(train) == 90 and len(valid) == 11 and not train & valid and train | valid == set(range(101))


def test_replica_shard_equal_shares(spark):
    df = spark.range(23).withColumnRenamed("id", "doc_id")
    r = L.replica_shard(df, "doc_id", 5, shuffle=True).collect()
    sizes = {}
    for row in r:
        sizes[row["replica"]] = sizes.get(row["replica"], 0) + 1
    assert sorted(sizes.values()) == [5] * 5 and len(r) == 25


def exact_fisher(a, b, c, d):
    n1, n2, k = a + b, c + d, a + c

    def pmf(x):
        return Fraction(comb(n1, x) * comb(n2, k - x), comb(n1 + n2, k))

    lo, hi = max(0, k - n2), min(k, n1)
    po = pmf(a)
    p = sum(pmf(x) for x in range(lo, hi + 1) if pmf(x) <= po * Fraction(10**7 + 1, 10**7))
    return float(min(p, 1))


@pytest.mark.parametrize("table", [(3, 1, 1, 3), (228, 15, 46, 0), (10, 0, 0, 10), (500, 480, 520, 500), (1, 2, 3, 4)])
def test_fisher_matches_exact_arithmetic(spark, table, monkeypatch):
    a, b, c, d = table
    ct = spark.createDataFrame([("high", a, b), ("low", c, d)], "score_level string, correct_0 long, correct_1 long")
    r = A.fisher_pairs(ct, "score_level", (("high", "low"),)).first()
    assert r["p_value"] == pytest.approx(exact_fisher(a, b, c, d), rel=1e-9, abs=1e-12)
    if b * c:
        assert r["odds_ratio"] == pytest.approx(a * d / (b * c))
    # a small chunk spreads the support over several tasks without changing the result
    monkeypatch.setattr(A, "FISHER_CHUNK", 7)
    r2 = A.fisher_pairs(ct, "score_level", (("high", "low"),)).first()
    assert r2["p_value"] == pytest.approx(r["p_value"], rel=1e-12)


@pytest.mark.parametrize("table", [(900, 10**10 - 900, 1100, 15 * 10**9 - 1100), (0, 10**10, 30, 10**10), (700, 10**10, 40, 10**6), (3 * 10**9, 10**9, 60, 25)])
def test_fisher_is_exact_at_margins_of_ten_billion(spark, table):
    """Against whole-number ratios of the terms."""
    a, b, c, d = table
    n1, n2, k = a + b, c + d, a + c
    lo, hi = max(0, k - n2), min(k, n1)
    if hi - lo > 10_000:  # the few-cell side, by symmetry
        lo = hi - 4000
    w, weights = 1, {}
    total = Fraction(0)
    terms = Fraction(1)
    lead = {}
    for x in range(lo, hi + 1):
        lead[x] = terms
        terms = terms * (n1 - x) * (k - x) / ((x + 1) * (n2 - k + x + 1)) if x < hi else terms
        if x % 50 == 0:  # keeps the fractions short; the relative error is far below the tolerance
            terms = Fraction(int(terms * 2**400), 2**400) if terms > Fraction(1, 2**200) else terms
    total = sum(lead.values())
    po = lead[a]
    want = float(sum(v for v in lead.values() if v <= po * Fraction(10**7 + 1, 10**7)) / total)
    ct = spark.createDataFrame([("high", a, b), ("low", c, d)], "score_level string, correct_0 long, correct_1 long")
    got = A.fisher_pairs(ct, "score_level", (("high", "low"),)).first()["p_value"]
    assert got == pytest.approx(want, rel=1e-6, abs=1e-290)


def test_hypergeometric_sums_to_one_at_large_margins():
    import numpy as np

    from quillspark.functions.stats import ln_hypergeom

    n1, n2, k = 10**10, 3 * 10**10, 2 * 10**10
    mean = k * n1 / (n1 + n2)
    sd = (mean * (1 - n1 / (n1 + n2)) * (n1 + n2 - k) / (n1 + n2 - 1)) ** 0.5
    x = np.arange(int(mean - 12 * sd), int(mean + 12 * sd))
    assert abs(np.exp(ln_hypergeom(x, n1, n2, k)).sum() - 1) < 1e-9


@pytest.mark.parametrize("t,dof,want", [(2.228138852, 10, 0.05), (12.7062047364, 1, 0.05), (0.0, 7, 1.0), (1.0, 1, 0.5), (1.959964, 10**9, 0.05), (-3.2906, 500_000, 0.001), (1.96, 2_000_000, 0.05), (0.6765, 8, 0.5178)])
def test_student_two_sided(spark, t, dof, want):
    from quillspark.functions.stats import student_two_sided

    r = spark.createDataFrame([(t, dof)], "t double, dof long").select(student_two_sided("t", "dof").alias("p")).first()
    assert r["p"] == pytest.approx(want, rel=2e-3 if want == 0.5178 else 2e-4)


def test_fisher_empty_margin(spark):
    ct = spark.createDataFrame([("high", 0, 0), ("low", 3, 4)], "score_level string, correct_0 long, correct_1 long")
    r = A.fisher_pairs(ct, "score_level", (("high", "low"),)).first()
    assert r["p_value"] == 1.0 and r["odds_ratio"] != r["odds_ratio"]  # NaN


def corpus(spark):
    texts = ["the cat sat on the mat . the dog sat on the log .",
             "a cat and a dog . the cat ran .", "the the the end", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    c = df.select("doc_id", F.posexplode(chunks(tokens("text"), 5)).alias("chunk_idx", "chunk"))
    return c


def test_decode_filter_sums_to_one(spark):
    model = M.fit(corpus(spark))
    for params in (M.DecodeParams(), M.DecodeParams(0.7, 1.3, 2, 0.9), M.DecodeParams(top_p=0.5)):
        t = M.decode_filter(model, params)
        sums = t.groupBy("ctx").agg(F.sum("prob").alias("s")).collect()
        assert sums and all(abs(r["s"] - 1) < 1e-12 for r in sums)
        if params.top_k:
            # more than k tokens survive only through ties at the k-th value
            by_ctx = {}
            for r in t.collect():
                by_ctx.setdefault(r["ctx"], []).append(r["prob"])
            for probs in by_ctx.values():
                probs.sort(reverse=True)
                if len(probs) > params.top_k:
                    assert all(abs(p - probs[params.top_k - 1]) < 1e-12 for p in probs[params.top_k:])


def test_chunk_loss_brute_force(spark):
    c = corpus(spark)
    model = M.fit(c)
    got = {(r["doc_id"], r["chunk_idx"]): r["loss"] for r in M.chunk_losses(model, c).collect()}
    rows = [(r["doc_id"], r["chunk_idx"], r["chunk"]) for r in c.collect()]
    big, uni = {}, {}
    for _, _, ch in rows:
        for i, t in enumerate(ch):
            ctx = M.BOS if i == 0 else ch[i - 1]
            big[(ctx, t)] = big.get((ctx, t), 0) + 1
            uni[t] = uni.get(t, 0) + 1
    N, V = sum(uni.values()), len(uni)
    ctxn = {}
    for (ctx, _), n in big.items():
        ctxn[ctx] = ctxn.get(ctx, 0) + n
    import math
    for d, ci, ch in rows:
        if not ch:
            continue
        ls = []
        for i, t in enumerate(ch):
            ctx = M.BOS if i == 0 else ch[i - 1]
            q = (uni.get(t, 0) + 1) / (N + V + 1)
            ls.append(-math.log((big.get((ctx, t), 0) + q) / (ctxn.get(ctx, 0) + 1)))
        assert got[(d, ci)] == pytest.approx(sum(ls) / len(ls), rel=1e-12)


def gen_inputs(spark):
    model = M.fit(corpus(spark))
    table = M.decode_filter(model, M.DecodeParams(top_p=0.96))
    prompts = spark.createDataFrame([(i, [w]) for i, w in enumerate(["the", "a", "cat", "dog", "zzz"])] + [(9, [])],
                                    "doc_id long, prompt_tokens array<string>")
    return prompts, table


def replayed(table, prompt, sample_idx, row_id, sample_len, seed=42, do_sample=True):
    """The draws of one sample, token by token."""
    import hashlib

    toks, step = list(prompt), 0
    while len(toks) < sample_len:
        followers = sorted((-r["mass"], r["tok"]) for r in table if r["ctx"] == (toks[-1] if toks else M.BOS))
        if not followers:
            break
        u = int(hashlib.md5(f"{seed}:{row_id}:{sample_idx}:{step}".encode()).hexdigest()[:8], 16) if do_sample else 0
        total, run = -sum(m for m, _ in followers), 0
        for m, tok in followers:
            run -= m
            if u < -(-run * 2**32 // total):
                break
        toks.append(tok)
        step += 1
    return " ".join(toks)


@pytest.mark.parametrize("do_sample", [True, False])
def test_generate_replays_and_does_not_depend_on_partitioning_or_join(spark, monkeypatch, do_sample):
    prompts, table = gen_inputs(spark)
    monkeypatch.setattr(G, "STEPS_PER_TABLE", 5)
    rows, run = table.collect(), lambda p: sorted(tuple(r) for r in G.generate(p, table, "doc_id", num_return_sequences=2, sample_len=12, do_sample=do_sample).collect())
    one = run(prompts.coalesce(1))
    want = sorted((str(r["doc_id"]), s, replayed(rows, r["prompt_tokens"], s, r["doc_id"], 12, do_sample=do_sample), 42) for r in prompts.collect() for s in (0, 1))
    assert one == want
    monkeypatch.setattr(G, "BROADCAST_CELL_BYTES", 0)
    assert run(prompts.repartition(8)) == one


def test_generation_stops_at_the_end_marker(spark):
    model = M.fit(corpus(spark), end="</s>")
    assert {r["ctx"] for r in model.bigrams.filter("tok = '</s>'").collect()} >= {"end", "."}
    table = M.decode_filter(model, M.DecodeParams())
    prompts = spark.createDataFrame([(i, ["the"]) for i in range(20)], "doc_id long, prompt_tokens array<string>")
    texts = [r["text"].split() for r in G.generate(prompts, table, "doc_id", sample_len=40, stop="</s>").collect()]
    assert all("</s>" not in t for t in texts) and any(len(t) < 40 for t in texts)


def test_vocab_lookup_of_head_and_tail(spark, monkeypatch):
    """Tokens beyond the head, longer than it takes, unknown ones, null lists; the corpus is not shuffled by token."""
    long = "x" * 100
    df = spark.createDataFrame([(1, ["b", "a", "b", "c"]), (2, []), (3, ["c", "c", "d", long, None]), (4, None), (5, [long, long, "b"])], "doc_id long, tokens array<string>")
    vocab = TK.build_vocab(df.filter("tokens is not null"), min_count=2)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    want = {r["doc_id"]: [ids.get(t, TK.UNK_ID) for t in r["tokens"] or []] for r in df.collect()}
    assert {r["doc_id"]: r["ids"] for r in TK.lookup_ids(df, vocab, "doc_id").collect()} == want
    monkeypatch.setattr(TK, "HEAD_ROWS", 5)
    out = TK.lookup_ids(df, vocab, "doc_id")
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == want
    monkeypatch.setattr(TK, "HEAD_ROWS", 100)
    monkeypatch.setattr(TK, "HEAD_TOKEN_BYTES", 200)
    plan = TK.lookup_ids(df, vocab, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan and "Exchange" not in plan


def test_unseen_pairs_by_shuffle_equal_broadcast(spark, monkeypatch):
    c = corpus(spark)
    model = M.fit(c.filter("doc_id < 2"))
    a = {(r["doc_id"], r["chunk_idx"]): r["loss"] for r in M.chunk_losses(model, c).collect()}
    monkeypatch.setattr(M, "MODEL_BROADCAST_ROWS", 0)
    b = {(r["doc_id"], r["chunk_idx"]): r["loss"] for r in M.chunk_losses(model, c).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-12) for k in a)


def test_chisq_closed_form(spark):
    ct = spark.createDataFrame([("a", 10, 20), ("b", 20, 10), ("c", 15, 15)], "lvl string, correct_0 long, correct_1 long")
    r = A.chisq(ct).first()
    obs = [[10, 20], [20, 10], [15, 15]]
    rs = [sum(x) for x in obs]
    cs = [sum(x[j] for x in obs) for j in range(2)]
    n = sum(rs)
    stat = sum((obs[i][j] - rs[i] * cs[j] / n) ** 2 / (rs[i] * cs[j] / n) for i in range(3) for j in range(2))
    import math
    assert r["statistic"] == pytest.approx(stat) and r["dof"] == 2 and r["p_value"] == pytest.approx(math.exp(-stat / 2))


@pytest.mark.parametrize("obs", [[[10, 20], [20, 10]], [[3, 1], [1, 3]], [[50, 48], [52, 50]]])
def test_chisq_odd_dof_matches_erfc(spark, obs):
    import math
    ct = spark.createDataFrame([(f"l{i}", r[0], r[1]) for i, r in enumerate(obs)], "lvl string, correct_0 long, correct_1 long")
    r = A.chisq(ct).first()
    rs = [sum(x) for x in obs]
    cs = [sum(x[j] for x in obs) for j in range(2)]
    n = sum(rs)
    stat = sum((obs[i][j] - rs[i] * cs[j] / n) ** 2 / (rs[i] * cs[j] / n) for i in range(2) for j in range(2))
    assert r["dof"] == 1 and r["statistic"] == pytest.approx(stat)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(stat / 2)), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("levels,scale", [(2, 1), (2, 1000), (3, 1), (4, 1), (4, 50), (5, 3), (2, 10**9), (40, 1), (40, 60)])
def test_chisq_upper_tail(spark, levels, scale):
    """Against the recurrence Q(a+1, x) = Q(a, x) + x^a e^-x / Gamma(a+1); large statistics give 0, not NaN."""
    import math

    obs = [((30 + 5 * i) * scale, (40 - (7 * i) % 11) * scale) for i in range(levels)]
    ct = spark.createDataFrame([(f"l{i}", *r) for i, r in enumerate(obs)], "lvl string, correct_0 long, correct_1 long")
    r = A.chisq(ct).first()
    x, dof = r["statistic"] / 2, levels - 1
    a, want = (1.0, math.exp(-x)) if dof % 2 == 0 else (0.5, math.erfc(math.sqrt(x)))
    while a < dof / 2:
        want += math.exp(a * math.log(x) - x - math.lgamma(a + 1))
        a += 1
    assert r["dof"] == dof and r["p_value"] == pytest.approx(want, rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("params", [M.DecodeParams(0.7, 1.3, 2, 0.9), M.DecodeParams(top_p=0.8), M.DecodeParams(0.5, 1.1, 0, 0.7)])
def test_hot_context_plan_equals_window_plan(spark, monkeypatch, params):
    """The skew-safe (range-partitioned) filter and cumulative table equal the window versions, digit by digit."""
    model = M.fit(corpus(spark))
    a = sorted(map(tuple, M.decode_filter(model, params).collect()))
    ta = sorted(map(tuple, G.cumulative(M.decode_filter(model, params)).collect()))
    monkeypatch.setattr(M, "CONTEXT_WINDOW_ROWS", 0)
    assert a == sorted(map(tuple, M.decode_filter(model, params).collect()))
    assert ta == sorted(map(tuple, G.cumulative(M.decode_filter(model, params)).collect()))


def test_ranges_and_cells_of_a_hot_context(spark, monkeypatch):
    """A Zipf context of 20,000 followers: every lo is the hi before it, the same on both plans; a draw meets one row of its cell."""
    n = 20_000
    z = sum(1.0 / (i + 1) for i in range(n))
    table = spark.range(n).select(F.lit("c").alias("ctx"), F.format_string("t%05d", "id").alias("tok"),
                                  (1.0 / (F.col("id") + 1) / z).alias("prob"))
    a = sorted(((r["rank"], r["lo"], r["hi"]) for r in G.cumulative(table).collect()))
    cells = G.cells(G.cumulative(table)).collect()
    monkeypatch.setattr(M, "CONTEXT_WINDOW_ROWS", 0)
    b = sorted(((r["rank"], r["lo"], r["hi"]) for r in G.cumulative(table).collect()))
    assert a == b and a[0][1] == 0 and a[-1][2] == 1 << G.DRAW_BITS
    assert all(x[2] == y[1] for x, y in zip(a, a[1:]))
    assert len(cells) < 2 * n
    by_cell = {}
    for r in cells:
        by_cell.setdefault(r["cell"], []).append((r["lo"], r["hi"]))
    for u in [0, 1, (1 << 32) - 1, *range(12345, 1 << 32, 10**7)]:
        assert sum(lo <= u < hi for lo, hi in by_cell[(u * n) >> 32]) == 1


@pytest.mark.parametrize("digits,rounds", [(3, 2), (1, 1), (1, 3)])
def test_row_at_equals_a_sort(spark, monkeypatch, digits, rounds):
    """Also with repeated and null ids, at both ends and past the end."""
    monkeypatch.setattr(L, "HISTOGRAM_DIGITS", digits)
    monkeypatch.setattr(L, "HISTOGRAM_ROUNDS", rounds)
    df = spark.createDataFrame([(i // 2 if i % 5 else 7,) for i in range(300)] + [(None,)] * 3, "doc_id long").repartition(4)
    keyed = df.select("doc_id", F.coalesce(L.hash_key("doc_id", "42"), F.lit("")).alias("_k"))
    order = sorted(((r["_k"], r["doc_id"] or -1) for r in keyed.collect()))
    for at in (0, 2, 3, 150, 301, 302):
        r = L.row_at(keyed, "_k", "doc_id", at)
        assert (r["_k"], r["doc_id"] if r["doc_id"] is not None else -1) == order[at]
    assert L.row_at(keyed, "_k", "doc_id", 303) is None


def test_datasets_by_name(spark):
    from quillspark.plans.datasets import dataset

    sf = "/root/testdata/sf0.001"
    rows = dataset(spark, sf, "web_text", "test").collect()
    assert rows and all(len(r["token_ids"]) == len(r["mask"]) == 194 and r["label"] in (0, 1) for r in rows)
    with pytest.raises(ValueError, match="unknown dataset"):
        dataset(spark, sf, "movies")
    with pytest.raises(ValueError, match="unknown split"):
        dataset(spark, sf, "essays", "dev")


@pytest.mark.parametrize("do_sample", [True, False])
def test_samples_walk_over_the_heavy_rows_and_join_the_others(spark, monkeypatch, do_sample):
    """The head takes the heaviest rows up to its bytes, the rest is joined; a repeated id keeps a row of its own."""
    prompts, table = gen_inputs(spark)
    prompts = prompts.unionAll(prompts.limit(2))
    monkeypatch.setattr(G, "BROADCAST_CELL_BYTES", 900)
    monkeypatch.setattr(G, "STEPS_PER_TABLE", 2)
    head, rest = G._split(G.with_next(G.cumulative(table)))
    assert 0 < head.count() <= 900 // 64 and rest.count() > 0
    assert head.agg(F.min("mass")).first()[0] > rest.agg(F.max("mass")).first()[0]
    rows = table.collect()
    got = sorted(tuple(r) for r in G.generate(prompts, table, "doc_id", sample_len=6, do_sample=do_sample).collect())
    assert got == sorted((str(r["doc_id"]), 0, replayed(rows, r["prompt_tokens"], 0, r["doc_id"], 6, do_sample=do_sample), 42) for r in prompts.collect())


@pytest.mark.parametrize("keys", [(), ("share",), ("share", "doc")])
def test_pair_counts_of_small_slices_equal_exploded_pairs(spark, monkeypatch, keys):
    """Tokens are counted inside the tasks, slice by slice; empty and null chunks, null tokens and keys, repeated rows."""
    monkeypatch.setattr(M, "COUNT_TOKENS", 5)
    rows = [(0, 1, ["a", "b", "a", "b", "a"]), (0, 1, ["a", "b"]), (None, 2, ["a", None, "a"]), (1, 3, []), (1, 4, None), (1, None, ["x"] * 9), (0, 1, ["<s>", "a"])]
    df = spark.createDataFrame(rows, "share int, doc long, chunk array<string>").coalesce(1)
    got = M.pair_counts(df, keys, out="m")
    want = M.pairs(df, keep=keys).groupBy(*keys, "ctx", "tok").agg(F.count(F.lit(1)).alias("m"))
    assert got.schema == want.schema or got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_lookup_works_on_slices_of_tokens(spark, monkeypatch):
    """A batch is cut by tokens, so that a worker's memory does not grow with the rows of a batch."""
    monkeypatch.setattr(TK, "COUNT_TOKENS", 4)
    lists = [["b", "a"], None, [], ["a"] * 9, ["z", "b"], ["a"]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>").coalesce(1)
    vocab = TK.build_vocab(df, min_count=1)
    assert {r["token"]: r["count"] for r in vocab.collect() if r["count"]} == {"a": 11, "b": 2, "z": 1}
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    got = {r["doc_id"]: r["ids"] for r in TK.lookup_ids(df, vocab, "doc_id").collect()}
    assert got == {i: [ids[t] for t in x or []] for i, x in enumerate(lists)}


def packed_corpus(spark):
    texts = ["the cat sat on the mat . the dog sat on the log .", "a cat and a dog . the cat ran . the the", "the the the end", "", None, "été the cat . a mat ran", "the dog . the dog . a log"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.select("doc_id", F.posexplode(chunks(tokens("text"), 5)).alias("chunk_idx", "chunk"))


@pytest.mark.parametrize("params", [M.DecodeParams(0.8, 1.2, 3, 0.96), M.DecodeParams(top_k=2, top_p=0.7)])
def test_packed_filter_equals_the_filter_of_rows(spark, monkeypatch, params):
    """M3 and the ranges of M4 without a window or a join by token; also when a task passes its pairs on early and buckets are few."""
    c = packed_corpus(spark)
    want = M.decode_filter(M.fit(c), params)
    ranges = {(r["ctx"], r["tok"]): (r["lo"], r["hi"]) for r in G.cumulative(want).where("hi > lo").collect()}
    want = {(r["ctx"], r["tok"]): (r["prob"], r["mass"]) for r in want.collect()}
    for held, buckets, words in ((1 << 21, 256, 250_000), (3, 2, 2)):
        monkeypatch.setattr(P, "HELD_PAIRS", held)
        monkeypatch.setattr(P, "BUCKETS", buckets)
        monkeypatch.setattr(P, "TOKEN_WORDS", words)
        monkeypatch.setattr(M, "COUNT_TOKENS", held)
        table = M.decode_filter(P.fit(c.repartition(3)), params)
        rows = {(r["ctx"], r["tok"]): (r["prob"], r["mass"]) for r in table.table().collect()}
        assert rows.keys() == want.keys() and all(rows[k][0] == pytest.approx(want[k][0], rel=1e-9) and rows[k][1] == pytest.approx(want[k][1], rel=1e-9) for k in rows)
        assert "Window" not in table.table()._jdf.queryExecution().toString()
        got = {}
        for r in table.ranges().collect():
            ctx, size, tok, at, lo, hi, _ = G._unpacked(bytes(r["blob"]))
            own = [w for w, k in zip(ctx.to_pylist(), size.tolist()) for _ in range(k)]
            got.update({(w, t): (a, b) for w, t, a, b in zip(own, tok.take(pa.array(at)).to_pylist(), lo.tolist(), hi.tolist())})
        assert got.keys() == ranges.keys() and all(abs(got[k][i] - ranges[k][i]) <= 4 for k in got for i in (0, 1))


@pytest.mark.parametrize("do_sample", [True, False])
def test_packed_generation_equals_the_join(spark, monkeypatch, do_sample):
    """Samples by the head alone, by rounds alone and by both; repeated ids, unknown and empty prompts, a stop token."""
    c = packed_corpus(spark)
    rows, table = M.decode_filter(M.fit(c), M.DecodeParams(top_p=0.96)), M.decode_filter(P.fit(c), M.DecodeParams(top_p=0.96))
    prompts = spark.createDataFrame([(i, [w]) for i, w in enumerate(["the", "a", "cat", "dog", "zzz", "the"])] + [(9, []), (9, []), (7, ["a"] * 7), (None, None)], "doc_id long, prompt_tokens array<string>")

    def run(t, **more):
        return sorted(map(str, G.generate(prompts, t, "doc_id", num_return_sequences=2, sample_len=7, do_sample=do_sample, **more).collect()))

    want, stopped = run(rows), run(rows, stop=".")
    assert want != stopped
    for head in (64 << 20, 0, 24 * 20):
        monkeypatch.setattr(G, "BROADCAST_CELL_BYTES", head)
        assert run(table) == want and run(table, stop=".") == stopped


def test_packed_pairs_take_a_few_bytes(spark):
    """What crosses the shuffle and stays on disk; as rows a pair took about twenty bytes."""
    c = spark.range(2000).select(F.expr("transform(sequence(1, 250), i -> concat('word', cast(floor(pow(pmod(xxhash64(id, i), 1000) / 1000.0, 4) * 3000) as string)))").alias("chunk"))
    pairs = P.written(P.counted(c), "pairs")
    n, size = pairs.agg(F.sum("pairs"), F.sum(F.octet_length("blob"))).first()
    assert n == M.pair_counts(c).count() and size < 8 * n


@pytest.mark.parametrize("whole", [7, 12345, (1 << 40) + 17, (1 << 61) + 3])
def test_scaled_is_exact(whole):
    part = np.array([0, 1, 2, whole // 3, whole // 2, whole - 1, whole], np.int64)
    assert P.scaled(part, np.full(len(part), whole)).tolist() == [-(-int(x) * 2**32 // whole) for x in part]


def test_sizes_come_with_the_lookup_and_no_corpus_is_cached(spark, monkeypatch, tmp_path):
    """The corpus of tokens and of ids is not kept in Spark's cache; a null list has no size, its chunk count is null as before."""
    from quillspark.functions.sequence import chunk_count
    from quillspark.plans import q_tokens

    lists = [["b", "a"], None, [], ["a"] * 9, ["z", "b", None], ["a"]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>").repartition(2)
    vocab = TK.build_vocab(df, min_count=2)
    for head in (200_000, 5):
        monkeypatch.setattr(TK, "HEAD_ROWS", head)
        packed = TK.packed_tokens(df, "doc_id")
        assert sorted(map(str, TK.build_vocab(packed, min_count=2).collect())) == sorted(map(str, vocab.collect()))
        ids, sizes = TK.lookup_sized(packed, vocab, "doc_id")
        assert {r["doc_id"]: r["n"] for r in sizes.collect()} == {i: None if x is None else len(x) for i, x in enumerate(lists)}
        assert sorted(map(str, ids.collect())) == sorted(map(str, TK.lookup_ids(df, vocab, "doc_id").collect()))
        assert "InMemoryRelation" not in sizes._jdf.queryExecution().withCachedData().toString()
    both = df.select(chunk_count(F.size("tokens"), 4).alias("a"), F.size(chunks("tokens", 4)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    kept = []
    monkeypatch.setattr(q_tokens, "doc_tokens", lambda spark, sf_dir, shared=False: kept.append(shared) or df)
    assert q_tokens.q_t12(spark, "").count() > 0 and not any(kept)
