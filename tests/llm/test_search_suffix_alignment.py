"""Hard negatives, suffix-array dedup and tokenizer alignment: brute force, odd rows, empty tables, hot groups."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import alignment, hard_negatives, substring_dedup, suffix_dedup, words

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten"


@pytest.fixture()
def many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


# hard negatives ------------------------------------------------------------------------------------------------------


def brute_negatives(rows, every=100, n_pos=5, n_neg=10):
    ok = [(i, y, v) for i, y, v in rows if y is not None and v is not None and all(x is not None for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in ok:
        if i is None or i % every:
            continue
        scored = [(-dot(v, w), math.inf if j is None else j, z) for j, z, w in ok if j != i]
        for p in sorted(x for x in scored if x[2] == y)[:n_pos]:
            fits = sorted(x for x in scored if x[2] != y and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0])[:n_neg]
            out += [(i, None if p[1] == math.inf else p[1], k, None if x[1] == math.inf else x[1], -p[0], -x[0]) for k, x in enumerate(fits, 1)]
    return Counter(out)


def some_vectors(n, dims, seed, clusters):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 60, (clusters, dims))
    own = rng.integers(0, clusters, n)
    return (centers[own] + rng.normal(0, 30, (n, dims))).astype(int), own


@pytest.mark.parametrize("seed,dims,clusters", [(1, 8, 3), (2, 7, 40), (3, 1, 2)])
def test_hard_negatives_equal_brute_force(spark, many_partitions, monkeypatch, seed, dims, clusters):
    monkeypatch.setattr(hard_negatives, "SAMPLE", 64)
    monkeypatch.setattr(hard_negatives, "SHARD", 50)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "CELL", 8)
    v, own = some_vectors(700, dims, seed, clusters)
    rows = [(i * 7, int(own[i] % 4), v[i].tolist()) for i in range(len(v))]
    rows += [(100_000 + i, 1, v[0].tolist()) for i in range(150)]  # copies of an anchor: ties
    rows += [(None, 2, v[1].tolist()), (300, None, v[2].tolist()), (400, 1, None), (500, 1, [None] * dims), (1400, 2, v[5].tolist()), (0, 0, [0] * dims), (10_000_000, 3, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").withColumn("block", F.lit("x")).withColumn("score", F.lit(1)).repartition(5)
    got = Counter(map(tuple, hard_negatives.hard_negatives(df).collect()))
    assert got == brute_negatives(rows) and len(got) > 50


def test_multi_sequence_visits_all_pairs_by_falling_bound():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=7), np.round(rng.normal(size=9), 1)
    seen = list(hard_negatives.multi_sequence(a, b))
    assert len({(i, j) for _, i, j in seen}) == len(seen) == 63
    assert all(abs(u - a[i] - b[j]) < 1e-12 for u, i, j in seen) and [u for u, _, _ in seen] == sorted((u for u, _, _ in seen), reverse=True)


def test_search_stops_before_the_last_cell(spark):
    """Clustered vectors: certified stops leave most cells out."""
    v, own = some_vectors(4000, 16, 5, 30)
    index = hard_negatives.MultiIndex(hard_negatives.k_means(v[:, :8], 20), hard_negatives.k_means(v[:, 8:], 20))
    (c1, d1), (c2, d2) = index.assign(v)
    for book, c, d in zip((0, 1), (c1, c2), (d1, d2)):
        np.maximum.at(index.radii[book], c, d)
    cell = c1 * 20 + c2
    order = np.argsort(cell, kind="stable")
    shard = hard_negatives.Shard(np.arange(4000)[order].tobytes(), own[order].astype(np.int64).tobytes(), cell[order].astype(np.int64).tobytes(), hard_negatives._packed(v[order]), 16, 20)
    visited = 0
    plain = shard.cells

    def counted(bounds, k):
        nonlocal visited
        for x in plain(bounds, k):
            visited += 1
            yield x

    shard.cells = counted
    q = v[:1]
    m, qm = hard_negatives.exact(shard.m, q)
    top, ids = hard_negatives.positives(shard, m, qm[0], index.bounds(q), 0, 0, int(own[0]), -math.inf, 5)
    scores = sorted(((-int(v[j] @ v[0]), j) for j in range(1, 4000) if own[j] == own[0]))[:5]
    assert [(-int(s), int(i)) for s, i in zip(top, ids)] == scores and visited < len(shard.spans)


def test_quantised_and_empty_embeddings(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, None), (3, [float("nan")]), (4, [float("inf"), 0.0]), (5, [None]), (6, [])], "i int, v array<float>")
    got = {r["i"]: r["q"] for r in df.select("i", hard_negatives.quantised("v").alias("q")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
    empty = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert hard_negatives.hard_negatives(empty).count() == 0


# suffix-array dedup --------------------------------------------------------------------------------------------------


def brute_removed(rows, n):
    """(doc_id, text) to the bytes removed of each row."""
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - n + 1):
            w = raw[p : p + n]
            first[w] = min(first.get(w, (math.inf, math.inf)), (key(i), p))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - n + 1):
            if first[raw[p : p + n]] < (key(i), p):
                gone[p : p + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def repetitive_rows(seed):
    rng = random.Random(seed)
    words = LOREM.split() + ["été", "日本語", "\x00\x00", "aaaa", "-" * 30]
    passages = [" ".join(rng.choice(words) for _ in range(rng.choice([10, 25, 60]))) for _ in range(6)]
    rows = []
    for k in range(90):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randrange(30))))
        text = " ".join(parts)
        if rng.random() < 0.4 and text:  # an edit inside
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz") + text[at + rng.randrange(2) :]
        rows.append((k if k % 10 else k // 10 * 3, text))  # some ids repeat with other texts
    return rows + [(None, LOREM * 2), (None, passages[0]), (200, None), (201, ""), (202, " \t\n"), (203, "x" * 3000), (204, "ab" * 900 + "c"), (5, rows[5][1]), (205, rows[5][1]), (206, LOREM * 30)]


@pytest.mark.parametrize("seed,classes,piece,n,gram", [(1, 4096, 1 << 20, 100, 32), (2, 2, 700, 100, 32), (3, 1, 1 << 20, 40, 12)])
def test_suffix_dedup_equals_brute_force(spark, many_partitions, monkeypatch, seed, classes, piece, n, gram):
    """Also with chunks of one or two classes, so that runs are compared between chunks, and with texts in pieces."""
    monkeypatch.setattr(suffix_dedup, "CLASSES", classes)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "ARRAY", 2000)
    rows = repetitive_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("doc", F.lit(1)).withColumn("start", F.lit(2)).repartition(6)
    out = suffix_dedup.without_repeats(df, n, gram)
    got = sorted(map(tuple, out.drop("spans").collect()), key=str)
    assert got == brute_removed(rows, n)
    assert sum(r[2] for r in got) > 1000


def test_maximal_repeats_have_all_occurrences(spark, many_partitions):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    texts = ["".join(rng.choice("ijklmnop ") for _ in range(60)) + passage[:k] + "".join(rng.choice("qrstuvwx ") for _ in range(60)) for k in (130, 130, 115, 130, 99)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.maximal_repeats(df).collect()
    held = {}
    for r in got:
        raw = texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["n_bytes"]]
        held.setdefault(r["repeat"], []).append((raw, r["doc_id"]))
    assert all(len({raw for raw, _ in v}) == 1 and len(v) > 1 for v in held.values())
    docs = {frozenset(d for _, d in v) for v in held.values()}
    assert frozenset({0, 1, 3}) in docs and frozenset({0, 1, 2, 3}) in docs
    covered = {d: set() for d in range(5)}
    for r in got:
        covered[r["doc_id"]] |= set(range(r["start"], r["start"] + r["n_bytes"]))
    assert [len(covered[d]) for d in range(5)] == [130, 130, 115, 130, 0]


def test_intervals_of_a_known_array():
    """Suffixes aab, aabx, aac, b: common prefixes 3, 2, 0."""
    found = list(suffix_dedup.intervals(np.array([0, 3, 2, 0, 0]), np.array([1, 1, 2, 5]), 2))
    assert found == [(3, 0, 1, [(0, 0), (1, 1)], False), (2, 0, 2, [(0, 1), (2, 2)], True)]


def test_suffix_dedup_of_no_rows_and_short_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.without_repeats(empty).count() == 0 and suffix_dedup.maximal_repeats(empty).count() == 0
    short = spark.createDataFrame([(1, "same"), (2, "same"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.without_repeats(short).collect()) == [(1, 4, 0, 0), (2, 4, 0, 0), (3, 0, 0, 0)]


# alignment -----------------------------------------------------------------------------------------------------------


def brute_alignment(rows):
    """Token by token, with the file's own library for the byte-level side."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(f"{alignment.VOCABULARIES}/{alignment.BYTE_BPE}")
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.VOCABULARIES}/{alignment.PIECE_BPE}")
    byte = alignment.byte_alphabet()
    entry = {i: s for s, i in a_side.get_vocab().items()}

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()

    counts, per = Counter(), []
    for i, t in rows:
        a = a_side.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.encode(t) if t else []
        raw_a, raw_b = [bytes(byte[c] for c in entry[x]) for x in a], [piece(x) for x in b]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            per.append((i, None))
            continue
        spans = []
        for ids, raw in ((a, raw_a), (b, raw_b)):
            at, out = 0, []
            for x, r in zip(ids, raw):
                out.append((x, at, at + len(r)))
                at += len(r)
            spans.append(out)
        links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if s < v and u < e]
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, s, _ in side if last <= s < c) for side in spans))
            last = c
        counts.update(links)
        per.append((i, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(((i, *(m[:3] if m else (0, 0, 0)), len(m[3]) if m else 0, sum(counts[x] == top[x[1]] for x in m[3]) if m else 0, sum(counts[x] for x in m[3]) if m else 0, m[4] if m else "") for i, m in per), key=str)


def test_alignment_equals_brute_force(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 2000)
    rng = random.Random(8)
    words = LOREM.split() + ["naïve", "日本語テキスト", "don't", "it's", "x1y2", "\n\n", "\t", "  ", "😀", "<|endoftext|>", "</s>", "<s>", "<0x41>", "ﬁ", "①", "▁", "\x00", " ", "12345", "!!!"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", "", "  "]) for _ in range(rng.randrange(1, 60)))) for k in range(120)]
    rows += [(k, rows[0][1]) for k in range(500, 540)] + [(3, rows[3][1]), (None, LOREM), (None, None), (600, None), (601, ""), (602, " "), (603, "a"), (604, LOREM * 5), (605, "x" * 3000), (606, "a▁b"), (607, "trailing  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("n", F.lit(2)).repartition(6)
    got = sorted(map(tuple, alignment.cross_tokenizer_alignment(df).collect()), key=str)
    want = brute_alignment(rows)
    assert got == want
    assert any(r[1] == 0 and r[0] == 606 for r in got) and sum(r[1] for r in got) > 3000


def test_alignment_of_the_given_texts_is_that_of_the_files_own_library(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{alignment.VOCABULARIES}/{alignment.BYTE_BPE}")
    own.encode_special_tokens = True
    a = alignment.tokenizers(alignment.VOCABULARIES)[0]
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect()]
    assert all(a.encode(t) == own.encode(" " + t, add_special_tokens=False).ids for t in texts)


def test_alignment_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.cross_tokenizer_alignment(empty).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.cross_tokenizer_alignment(none).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# substring dedup -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("collides", ["first", "second"])
def test_substring_dedup_survives_a_collision_of_either_hash(spark, many_partitions, monkeypatch, collides):
    """Every window has the same value of one of the two hashes; the other tells them apart."""
    plain = words.Words.windows

    def windows(self, n, salt=0, base=words._R):
        out = plain(self, n, salt, base)
        whole = salt == 0 and (base == words._R) == (collides == "first")
        return out * np.uint64(0) if whole else out

    # the plan runs in other processes: the patched class goes with the functions
    monkeypatch.setattr(words.Words, "windows", windows)
    w = LOREM.split()
    texts = [" ".join(w), "start " + " ".join(w[:25]) + " end of it", " ".join(w[5:30]) + " tail", " ".join(reversed(w)), "other " + " ".join(w[:22])]
    rows = list(enumerate(texts))
    buf = [t.split() for t in texts]
    first = {}
    for i, ws in enumerate(buf):
        for p in range(len(ws) - 19):
            first.setdefault(tuple(ws[p : p + 20]), (i, p))
    want = []
    for i, ws in enumerate(buf):
        gone = set()
        for p in range(len(ws) - 19):
            if first[tuple(ws[p : p + 20])] < (i, p):
                gone |= set(range(p, p + 20))
        want.append((i, len(ws), len(gone)))
    batch = pytest.importorskip("pyarrow").RecordBatch.from_pydict({"doc": [i for i, _ in rows], "text": texts})
    found = [x for b in substring_dedup._window_rows(20, 6, lambda h: np.ones(len(h), bool))(iter([batch])) for x in b.to_pylist()]
    by = {}
    for x in found:
        by.setdefault((x["h"], x["g"]), []).append((x["doc"], x["start"]))
    removed = {i: set() for i, _ in rows}
    for places in by.values():
        for doc, start in sorted(places)[1:]:
            removed[doc] |= set(range(start, start + 20))
    assert [(i, n, len(removed[i])) for i, n, _ in want] == want and sum(r[2] for r in want) > 40
    assert len({x["h"] for x in found}) == 1 or len({x["g"] for x in found}) == 1
