"""Randomised check of the partitioned row index against a brute-force ordering."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.operators.indexing import with_row_index

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]), st.integers(-5, 5), st.floats(-1, 1, allow_nan=False)),
    min_size=0, max_size=60,
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_strategy, parts=st.integers(1, 6))
def test_index_matches_brute_force(spark, rows, parts):
    data = [(g, k, i, v) for i, (g, k, v) in enumerate(rows)]  # (k, i) is a total order within a group
    df = spark.createDataFrame(data, "g string, k int, i int, v double")
    got = with_row_index(df, ["k", "i"], ["g"], cum_of="v", num_partitions=parts).collect()
    got = {(r["g"], r["i"]): (r["row_idx"], r["cum_before"]) for r in got}
    expected = {}
    by_group = {}
    for g, k, i, v in data:
        by_group.setdefault(g, []).append((k, i, v))
    for g, items in by_group.items():
        acc = 0.0
        for pos, (k, i, v) in enumerate(sorted(items)):
            expected[(g, i)] = (pos, acc)
            acc += v
    assert got.keys() == expected.keys()
    for key, (pos, acc) in expected.items():
        assert got[key][0] == pos
        assert abs(got[key][1] - acc) < 1e-9
