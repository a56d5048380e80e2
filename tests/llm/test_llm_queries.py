"""The training-data queries against their SQL, against brute force on hand-made rows, and on degenerate tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, decontaminate, exact_dedup, flow, language_id, line_dedup, lm_scoring, mixing, ngram_join, pii, quality, store, substring_dedup
from quillspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def bag(pdf):
    cols = sorted(pdf.columns)
    return cols, Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture()
def many_partitions(spark):
    """More partitions than AQE would leave, so that merging partial results is tested."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, many_partitions, name):
    assert bag(QUERIES[name](spark, SF).toPandas()) == bag(con.execute(SQL[name]).df())


def test_id_filter_keeps_every_id_over_many_partitions(spark, many_partitions):
    import numpy as np

    ids = spark.range(0, 50_000, 7, numPartitions=9)
    hit = store.id_filter(ids, ids.count())
    assert hit(np.arange(0, 50_000, 7)).all() and hit(np.arange(10**6, 10**6 + 10_000)).mean() < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def odd_rows():
    """Nulls, empties, white space, a very long text, ties and repeated rows."""
    w = LOREM.split()
    return [(None, LOREM), (1, None), (2, ""), (3, " \t\n"), (4, LOREM), (4, LOREM), (5, LOREM.upper()), (6, " ".join(w * 3000)), (7, "x" * 300_000), (8, "alpha beta"), (9, "Alpha  beta"), (10, "é ü 日本語 \x0b ß"), (11, "!!! ###"), (12, LOREM + " extra")]


@pytest.fixture()
def odd(spark):
    """Extra columns have the names that operators use inside."""
    rows = [(i, t, "en", "s", 1, "x", 2, 3) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, key string, h int, n long")


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup_odd_rows(spark, odd):
    out = exact_dedup.exact_dedup(odd)
    rows = out.collect()
    assert len(rows) == len(odd_rows())
    group = Counter(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest() for _, t in odd_rows())
    assert all(r["group_size"] == group[r["text_sha256"]] for r in rows)
    assert sum(r["kept"] for r in rows) == len(group)
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {3} and {r["keep_id"] for r in rows if r["doc_id"] in (None, 4)} == {4}
    kept = exact_dedup.keep_distinct(odd)
    assert kept.columns == odd.columns and kept.count() == len(group)


def test_exact_dedup_lengthens_ambiguous_identifiers(spark):
    r = spark.createDataFrame([(0, [1, 2], [b"a", b"b"]), (1, [1, 2], [b"a", b"c"]), (2, [1, 2], [b"a", b"b"]), (3, [], [])], "row long, fps array<long>, checks array<binary>")
    got = {x["row"]: x["recipe"] for x in exact_dedup.with_identifiers(r).collect()}
    assert got[0] == got[2] != got[1] and got[3] == []


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared) or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = {}
    for x, (i, _) in zip(label, rows):
        if i is not None:
            first[x] = min(first.get(x, i), i)
    return sorted(((i, len(s), first.get(x, i)) for (i, _), s, x in zip(rows, sets, label)), key=str)


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join_odd_rows_and_near_copies(spark, odd, many_partitions, n, num, den):
    import random

    rng, w = random.Random(5), LOREM.split() * 4
    near = []
    for k in range(60):
        x = rng.sample(w, len(w)) if k % 15 == 0 else list(x0)
        x0 = x if k % 15 == 0 else x0
        x = list(x)
        for _ in range(k % 4):
            x[rng.randrange(len(x))] = f"new{rng.random()}"
        near.append((100 + k, " ".join(x)))
    rows = [r for r in odd_rows() if r[0] is not None] + near
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, num, den)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, n, num, den)
    with_null = ngram_join.jaccard_components(odd, n, num, den).collect()
    assert [r["component_id"] for r in with_null if r["doc_id"] is None] == [4]
    assert ngram_join.keep_one_of_each(odd, n, num, den).columns == odd.columns


def test_near_stage_keeps_one_row_of_each_component_whatever_the_ids(spark, many_partitions):
    other = " ".join(f"w{k}" for k in range(40))
    rows = [(None, LOREM), (4, LOREM), (None, LOREM + " extra"), (None, other), (None, other + " more"), (7, "alone here"), (7, LOREM), (2, LOREM), (None, ""), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").coalesce(1)
    kept = ngram_join.keep_one_of_each(store.written(docs, "t-near"))
    assert kept.columns == docs.columns and sorted(r["n"] for r in kept.collect()) == [3, 5, 7, 8, 9, 10]


def brute_repeats(rows, n):
    seen, out = {}, []
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - n + 1):
            x, at = tuple(w[s : s + n]), (math.inf if i is None else i, s)
            seen[x] = min(seen.get(x, at), at)
    for i, t in rows:
        w, gone = words(t), set()
        for s in range(len(w) - n + 1):
            if (math.inf if i is None else i, s) > seen[tuple(w[s : s + n])]:
                gone |= set(range(s, s + n))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_odd_rows(spark, odd, many_partitions):
    small = [r for r in odd_rows() if r[0] != 6] + [(6, " ".join(LOREM.split() * 6)), (20, "a " + LOREM + " b " + LOREM), (21, "same " * 90)]
    got = substring_dedup.without_repeats(spark.createDataFrame(small, "doc_id long, text string").repartition(4)).drop("removed")
    assert sorted(map(tuple, got.collect()), key=str) == brute_repeats(small, 20)
    assert substring_dedup.without_repeats(odd).count() == len(odd_rows())


def test_decontamination_spans_lead_to_the_original_text(spark, odd, monkeypatch):
    item = "Alpha, BETA-gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "..."), (4, "日本語"), (4, "日本語")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.benchmark_hits(odd, bench).collect()}
    assert found[5]["items"] == ["1"] and len(found[5]["hits"]) == 11
    s = found[5]["spans"][0]
    assert LOREM.upper()[s["start"] : s["end"]] == "ALPHA BETA GAMMA DELTA EPSILON ZETA ETA THETA IOTA KAPPA LAMBDA"
    s = found[10]["spans"][0]
    assert found[10]["items"] == ["4"] and odd_rows()[11][1][s["start"] : s["end"]] == "日本語"
    assert not found[1]["hits"] and found[1]["n_words"] == 0
    clean = decontaminate.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and {r["doc_id"] for r in clean.select("doc_id").collect()} == {1, 2, 3, 7, 8, 9, 11}
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 40)  # several automata
    again = {r["doc_id"]: r for r in decontaminate.benchmark_hits(odd, bench).collect()}
    assert all(again[k]["hits"] == found[k]["hits"] and again[k]["items"] == found[k]["items"] for k in found)


def test_decontamination_by_several_automata_equals_one(spark, monkeypatch):
    """Null and repeated ids decide nothing, and windows of different automata that overlap or touch are one span."""
    run, other = LOREM.split()[:24], "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(k, " ".join(run[k : k + 10])) for k in range(0, 14, 2)] + [(50, " ".join(run[14:24])), (60, other)], "item_id long, text string")
    rows = [(None, "x " + " ".join(run) + " y"), (None, "clean"), (1, " ".join(run[:10])), (1, "clean too"), (2, f"{other} x {' '.join(run[2:16])}"), (3, " ".join(run[:9])), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3).cache()
    hits = lambda: Counter(map(repr, decontaminate.benchmark_hits(docs, bench).collect()))
    kept = lambda: sorted(r["row"] for r in decontaminate.drop_contaminated(docs, bench).collect())
    one = hits(), kept()
    assert one[1] == [1, 3, 5, 6, 7]
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 60)
    assert (hits(), kept()) == one


def test_flow_prefers_first_copies_of_overlapping_sources():
    out = flow.route([100, 50, 30], [150, 60, 10], [[0], [0, 1], [1, 2]], 2)
    by_source = [sum(sum(p[s]) for p in out) for s in range(3)]
    second = sum(p[s][1] for p in out for s in range(3))
    assert by_source == [150, 60, 10] and second == 40
    assert mixing.level_targets([100, 10, 10], [1, 1, 1]) == [140.0, 20.0, 20.0]


def test_mixing_odd_rows(spark, odd):
    rows = odd.withColumn("source", F.when(F.col("doc_id") > 6, None).otherwise(F.col("source")))
    out = mixing.mix(rows, F.array("source"), mixing.word_count(F.col("text")), mixing.query_quotas()).collect()
    size = Counter(len(words(t)) for _, t in odd_rows())
    assert Counter(r["size"] for r in out) == size and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    for s in {tuple(r["members"]) for r in out}:
        own = [r for r in out if tuple(r["members"]) == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    overlap = mixing.mix(odd, F.when(F.col("doc_id") < 6, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))), mixing.word_count(F.col("text")), mixing.query_quotas())
    assert overlap.where("taken > 2 * size").count() == 0


def test_mixing_of_any_number_of_sources(spark, monkeypatch):
    """More sources than the bound of the flow: targets equal the plain levels, each source gives its target; overlaps still go to the flow."""
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    rows = [(i if i % 9 else None, f"s{i % 40:02d}" if i % 41 else None, i * i % 23) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n long")
    held = Counter()
    for _, s, n in rows:
        held[s] += n
    order = sorted(held, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.level_targets([held[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])))
    out = mixing.mix(d, F.array("source"), F.col("n"), mixing.query_quotas()).collect()
    assert len(out) == 400 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    for s in order:
        own = [r for r in out if r["members"] == [s]]
        assert own[0]["target"] == want[s] and own[0]["source_size"] == held[s] and sum(r["taken"] for r in own) == round(want[s])
    both = F.when(F.col("source") == "s01", F.array(F.lit("s01"), F.lit("s02"))).otherwise(F.array("source"))
    mixed = mixing.mix(d, both, F.col("n"), mixing.query_quotas()).collect()
    assert len(mixed) == 400 and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    several = F.when(F.col("doc_id") < 200, F.array(F.col("source"), F.lit("t"))).otherwise(F.array("source"))
    with pytest.raises(ValueError, match="overlap"):
        mixing.mix(d, several, F.col("n"), mixing.query_quotas())


def test_quality_scores(spark, odd, labels):
    out = quality.quality_scores(odd, labels).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert {r["score"] for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    real, marks = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.01/labels.parquet")
    seen = quality.quality_scores(real, marks).where("held_out").join(marks, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert seen > 0.95


def test_isotonic_pools():
    import numpy as np

    assert quality.isotonic(np.array([1, 1, 0, 2]), np.array([1.0, 0, 0, 2])).tolist() == [0.5, 0.5, 0.75, 1.0]


def test_language_id(spark, odd):
    out = {r["doc_id"]: r for r in language_id.language_scores(odd).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[11]["lang_pred"] == "und" and out[11]["score"] == 0
    assert out[10]["lang_pred"] == "en" and 0 <= out[7]["score"] <= 1
    assert language_id.language_scores(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    real = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet")
    seen = language_id.language_scores(real).where("held_out").join(real, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert seen > 0.97


def test_forward_sums_all_segmentations():
    import numpy as np
    import pyarrow as pa

    pieces = [b" ", b" a", b"a", b"ab", b"b", b"abb"]
    p = np.array([[0.1, 0.2, 0.3, 0.15, 0.2, 0.05, 0.0]])
    got = math.exp(language_id.word_scores(pa.array([b"abb"], pa.binary()), language_id.Lattice(pieces), p)[0, 0])

    def total(rest):
        return 1.0 if not rest else sum(p[0, i] * total(rest[len(x) :]) for i, x in enumerate(pieces) if rest.startswith(x))

    assert abs(got - total(b" abb")) < 1e-12


def test_lm_scores_prefer_the_target(spark, odd):
    target = spark.createDataFrame([("alpha beta gamma delta " * 50,), (None,)], "text string")
    out = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(odd, target).collect()}
    assert out[1]["score"] == 0 and out[2]["n_words"] == 0 and out[8]["score"] > out[7]["score"]
    assert all(math.isfinite(r["score"]) for r in out.values())
    assert lm_scoring.cross_entropy_difference(odd, target.limit(0)).count() == len(odd_rows())


@pytest.mark.parametrize("leave_out, heads", [(False, None), (True, None), (False, (3, 2)), (True, (3, 2)), (True, (0, 0))])
def test_lm_scores_equal_bigram_models_of_all_words(spark, odd, many_partitions, monkeypatch, leave_out, heads):
    """Against counters of all words and pairs, with and without a document's own counts, and with heads that hold next to nothing."""
    if heads:
        monkeypatch.setattr(lm_scoring, "HEAD_WORDS", heads[0])
        monkeypatch.setattr(lm_scoring, "HEAD_PAIRS", heads[1])
    aim = ["alpha beta gamma delta " * 50, None, "rare1 rare2 alpha"]
    many = [(100 + k, f"word{k} word{k + 1} rare{k % 3} the the") for k in range(400)]
    rows = [(i, t) for i, t in odd_rows() if i != 6] + many
    fold = {c: c + 32 for c in range(65, 91)}
    back, front = ([[x.translate(fold) for x in words(t)] for t in texts] for texts in ([t for _, t in rows], aim))
    vocabulary = {x for ws in back + front for x in ws}

    def counts(corpus):
        one, two, before = Counter(), Counter(), Counter()
        for ws in corpus:
            one.update(ws)
            two.update(zip([None, *ws], ws))
            before.update([None, *ws][: len(ws)])
        return one, two, before

    def loss(model, own, ws):
        one, two, before = ({k: c[k] - o.get(k, 0) for k in {*c}} for c, o in zip(model, own))
        total = sum(one.values()) + 0.5 * len(vocabulary)
        p = {x: (one.get(x, 0) + 0.5) / total for x in ws}
        return -sum(math.log((two.get((v, x), 0) + 20 * p[x]) / (before.get(v, 0) + 20)) for v, x in zip([None, *ws], ws)) / max(1, len(ws))

    target, background = counts(front), counts(back)
    none = ({}, {}, {})
    want = sorted([(i, len(ws), loss(target, none, ws), loss(background, counts([ws]) if leave_out else none, ws)) for (i, _), ws in zip(rows, back)], key=lambda r: str((r[0], r[1], round(r[2], 4))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lm_scoring.cross_entropy_difference(docs, spark.createDataFrame([(t,) for t in aim], "text string"), leave_out=leave_out).collect()
    got = sorted([(r["doc_id"], r["n_words"], r["loss_target"], r["loss_background"]) for r in out], key=lambda r: str((r[0], r[1], round(r[2], 4))))
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 and abs(a[3] - b[3]) < 1e-5 for a, b in zip(got, want))


def test_line_dedup(spark, odd, many_partitions):
    long = "this long line tells about the many harbours and the ships that lie in them during winter until the ice has gone away"
    rows = [(1, f"{long}\nother words here\n\n"), (2, f"\n{long.upper()}"), (3, long.replace("winter", "winters") + "\nOther  words here"), (4, None), (5, ""), (None, long), (6, "page 12 of 30\npage 13 of 30")]
    out = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.fuzzy_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (4, 0, []) and out[2] == (2, 1, [1]) and out[4] == (0, 0, []) and out[5] == (1, 0, []) and out[None] == (1, 1, [0]) and out[6] == (2, 1, [1])
    assert 1 in out[3][2]
    assert line_dedup.fuzzy_line_dedup(odd).count() == len(odd_rows())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_finds_what_edit_similarity_finds(spark, many_partitions):
    """Real lines beside copies with as many random edits as the threshold allows, or with replaced words: at least 97% of the linked copies are found."""
    import random

    rng, lines = random.Random(3), set()
    for r in spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet").select("text").orderBy("doc_id").limit(250).collect():
        lines |= {" ".join(re.sub("[0-9]", "0", x).lower().split()) for x in r["text"].split("\n") if x.isascii()}
    bases = rng.sample(sorted(x for x in lines if 10 <= len(x) <= 160), 300)
    pairs = []
    for k, x in enumerate(bases):
        most, y = len(x) // 10, list(x)
        if k % 3:
            for _ in range(most if k % 3 == 1 else max(1, most // 2)):
                at = rng.randrange(len(y))
                y[at : at + 1] = rng.choice([[], [rng.choice("qzxvk")], [y[at], rng.choice("qzxvk")]])
            y = "".join(y)
        else:
            y = x.split()
            while True:
                z = list(y)
                z[rng.randrange(len(z))] = "".join(rng.choices("qzxvk", k=4))
                if edit_distance(x, " ".join(z)) > most or sum(a != b for a, b in zip(x.split(), y)) > 5:
                    break
                y = z
            y = " ".join(y)
        y = " ".join(y.split())
        if x != y and edit_distance(x, y) <= math.floor(0.1 * max(len(x), len(y)) + 1e-9):
            pairs.append((x, y))
    assert len(pairs) > 200 and min(len(x) for x, _ in pairs) < 20
    rows = [(2 * k + side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)]
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.fuzzy_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(out[2 * k + 1] for k in range(len(pairs))) / len(pairs)
    print(f"recall {found:.3f} of {len(pairs)}")
    assert found >= 0.97


def test_line_dedup_writes_less_than_it_reads(spark, tmp_path):
    """Scratch tables of the candidate search, against the size of the texts (before: seven times that)."""
    from pathlib import Path

    docs = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet").select("doc_id", "text")
    folder = Path(store.scratch_path(spark, "x").removeprefix("file:")).parent
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = size()
    assert line_dedup.fuzzy_line_dedup(docs).count() == docs.count()
    assert size() - before < docs.agg(F.sum(F.octet_length("text"))).first()[0] / 2


def test_line_dedup_with_many_lines_that_share_keys(spark):
    """More lines with one beginning than are compared in a bucket; only the copies with two edits go."""
    import random

    rng = random.Random(4)
    head = "the very same words begin each of these many lines and go on until here "
    tails = ["".join(rng.choices("abcdefghijklmnopqrstuvw", k=60)) for _ in range(700)]
    copies = [head + t[:10] + "x" + t[11:40] + "y" + t[41:] for t in tails[::35]]
    rows = list(enumerate([head + t for t in tails] + copies))
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.fuzzy_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, n in out.items() if n} == set(range(700, 720))


def test_bounded_edit_distance():
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    for letters in ("ab", "abcdefgh \u00e9", "".join(map(chr, range(0x4E00, 0x4F90))) + "ab\U0001f600"):
        xs, ys = [], []
        for _ in range(400):
            x = rng.choices(letters, k=rng.randrange(50))
            y = list(x)
            for _ in range(rng.randrange(14)):
                if y:
                    at = rng.randrange(len(y))
                    y[at : at + 1] = rng.choice([[], [rng.choice(letters)], [y[at], rng.choice(letters)]])
            xs.append("".join(x))
            ys.append("".join(y))
        most = np.array([rng.randrange(10) for _ in xs])
        assert line_dedup.within(pa.array(xs), pa.array(ys), most).tolist() == [edit_distance(x, y) <= m for x, y, m in zip(xs, ys, most)]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def passes(kind, v):
        d = re.sub("[^0-9]", "", v)
        luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return [(i, m.start(), m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_pii_base_spans_equal_plain_patterns(spark, odd):
    hard = ["a@b.co_x@d.com a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.04 é 10.0.0.1.", "4111 1111 1111 1111 4111-1111-1111-1111x4111111111111111 1", "+1 (555) 010-9999, +44 20 7946 0958+4 +1-2-3-4-5-6-7-8-9",
            None, "", " ", "0" * 5000, "+" + "1 " * 3000, "x" * 30000 + "@", "1." * 2000, "a@" + "b." * 3000 + "c", ".@..@.a-@-.-.", "𝒳𝒳 me@ex.org 𝒳 +49 30 1234567"]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["base"]] for r in pii.personal_data(df).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(hard)}
    assert pii.personal_data(odd).count() == len(odd_rows())


def test_pii_patterns_discover_unseen_identifiers(spark):
    seeds = [(i, f"please write to user{i}@mail.example.com now") for i in range(12)]
    rows = [*seeds, (20, "please write to user9(at)mail99 now"), (21, "the year 1999 was good"), (22, "they saw 12 birds")]
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in out[20]["spans"]] == [(0, 16, 31)] and not out[20]["base"]
    assert not out[21]["spans"] and not out[22]["spans"] and [tuple(x) for x in out[0]["spans"]] == [tuple(x) for x in out[0]["base"]] != []


def brute_words_before(text):
    """Two white-space words before each candidate, an earlier candidate as its shape."""
    out, words_so_far = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if re.search("[0-9@]", m.group()):
            out.append(((m.start(), m.end()), " ".join(words_so_far[-2:])))
            words_so_far.append(re.sub("[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", m.group())))
        else:
            words_so_far.append(m.group())
    return out


def test_pii_contexts_are_the_two_words_before_whatever_they_are(spark):
    texts = ["id 4711 0815 then\t 12  a@b.c d@e.f x 7 8 9", "1", "  1 two\n\n3", "a b c 1", "x" * 200 + " y 5 6", "none", "é ü1 ö 2 3", " ".join(f"w{i % 3 or 'x'} v" for i in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", "text", pii._matches(F.col("text"), pii.CANDIDATE, context=True).alias("m")).collect():
        assert [((x["s"], x["e"]), x["b"]) for x in r["m"]] == brute_words_before(r["text"])


def test_pii_rounds_go_on_to_the_end_of_a_chain(spark):
    """Ten of twelve known values are too few for a pattern, eleven are enough: each value is found a round after the one before."""
    chain = [f"v{'.' * k}{k}(at)h" for k in range(6)]
    rows = [(i, f"mail to u{i}@m.example.com") for i in range(12)] + [(100, f"mail to {chain[0]}")]
    for k in range(1, 6):
        rows += [(1000 * k + i, f"step{'-' * k} to u{i}@m.example.com") for i in range(10)]
        rows += [(1000 * k + 100, f"step{'-' * k} to {chain[k - 1]}"), (1000 * k + 101, f"step{'-' * k} to {chain[k]}")]
    rows += [(901, "years 1999 and 2001"), (902, None), (902, None)]
    rows += [(910 + i, f"team: a{i}@m.example.com b{i}@m.example.com c{i}@m.example.com") for i in range(12)] + [(930, "team: a99@m.example.com b99@m.example.com zz9#m.example.org")]
    found = {}
    for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]] = [(x["s"], x["e"]) for x in r["spans"] if x not in r["base"]]
    text = dict(rows)
    for k in range(6):
        for doc in [100] if not k else [1000 * k + 100, 1000 * k + 101]:
            assert found[doc] == [(text[doc].index("to ") + 3, len(text[doc]))], doc
    assert found[901] == found[902] == found[0] == []
    assert found[930] == [(text[930].index("zz9"), len(text[930]))]  # the context of a list's later entry is the shapes of the ones before


def test_pii_a_text_of_many_candidates_takes_time_in_proportion(spark):
    n = 100_000
    text = " ".join(f"{i % 256}.1.2.3 w{i}" for i in range(n // 2))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.personal_data(df).first()
    assert r["n_ip"] == n // 2 and [tuple(x) for x in r["base"]][-3:] == plain_spans(text)[-3:]


@pytest.mark.parametrize("op", [exact_dedup.exact_dedup, ngram_join.jaccard_components, substring_dedup.without_repeats, line_dedup.fuzzy_line_dedup, language_id.language_scores, pii.personal_data, exact_dedup.keep_distinct, ngram_join.keep_one_of_each])
def test_empty_tables(spark, odd, op):
    assert op(odd.limit(0)).count() == 0


def test_empty_tables_of_two(spark, odd, labels):
    none, bench = odd.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert quality.quality_scores(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0
    assert decontaminate.benchmark_hits(none, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench).count() == len(odd_rows())
    assert lm_scoring.cross_entropy_difference(none, none).count() == 0
    assert mixing.mix(none, F.array("source"), mixing.word_count(F.col("text")), mixing.query_quotas()).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.quality_stage(spark, docs, SF)
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    assert kept.columns == docs.columns and kept.join(marks.where("quality = 1"), "doc_id").count() >= 0.98 * marks.where("quality = 1").count()
    one = store.written(cp.exact_stage(spark, docs, SF), "t1")
    rows = [(r["doc_id"], r["text"]) for r in one.select("doc_id", "text").collect()]
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in rows}) == docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")).distinct().count()
    two = store.written(cp.near_stage(spark, one, SF), "t2")
    assert sorted(r["doc_id"] for r in two.select("doc_id").collect()) == sorted(i for i, _, c in brute_components(rows, 5, 4, 5) if i == c)
    three = cp.benchmark_stage(spark, two, SF)
    hits = decontaminate.benchmark_hits(two, spark.read.parquet(f"{SF}/benchmark.parquet")).where(F.size("hits") > 0).count()
    assert three.count() == two.count() - hits and three.columns == docs.columns
    out = cp.mixing_stage(spark, three, SF)
    assert out.count() == three.count() and out.where("taken > 2 * size or taken < 0").count() == 0


def test_stages_keep_columns_with_inner_names(spark):
    """Columns named like those the stages add come back unchanged; rows are numbered once, also after a round-robin deal."""
    rows = [(i, f"{LOREM} {'x' * (i % 3)}", f"r{i}", f"o{i}", i, f"s{i}", -i) for i in range(40)] + [(40, "another text", "r40", "o40", 40, "s40", -40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string, __own string, __n int, __sha string, __id int").repartition(7)
    near = ngram_join.keep_one_of_each(df)
    assert near.columns == df.columns and sorted(map(tuple, near.collect())) == [rows[0], rows[40]]
    exact = exact_dedup.keep_distinct(df)
    assert exact.columns == df.columns and sorted(map(tuple, exact.collect())) == [*rows[:3], rows[40]]
    bench = spark.createDataFrame([("a", "another text")], "item_id string, text string")
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns and sorted(map(tuple, clean.collect())) == rows[:40]


def test_whole_texts_are_kept_compact(spark, monkeypatch):
    """The numbered copy of the documents is the largest table that near-duplicate removal writes."""
    codecs = {}
    whole = store.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name, **kw: codecs.update({name: kw.get("codec")}) or whole(df, name, **kw))
    docs = spark.createDataFrame([(i, "one two three four five six seven " + "eight" * (i % 2)) for i in range(6)], "doc_id long, text string")
    assert ngram_join.keep_one_of_each(docs).count() == 2
    assert codecs["numbered"] == "zstd" and codecs["prefixes"] is None
