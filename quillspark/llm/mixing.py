"""Mixing sources to target weights by min-cost flow over membership patterns.

A document can belong to several sources; documents with the same set of sources form a pattern. Spark sums
the words of each pattern. A min-cost flow routes their words to the sources' quotas, where a further repetition of the same words costs
more. A source that shares no document with another has one pattern and one way for its words: that flow is a minimum, taken in Spark
columns for any number of sources. Only patterns of sources that overlap go to the driver, at most ``MAX_PATTERNS`` of them (an error
beyond). Spark then selects documents in a seeded hash order until each pattern has given what the flow asks of it. The last document of a pattern gives a part, so that the
words taken equal the flow.

The hash order never gathers a pattern: words are summed for ``2**BITS`` ranges of the hash, then again inside the one
range where the pattern's words run out, and only the documents of that small range are put in order.

Null texts and texts without words have size 0 and give nothing. A null source is a source of its own, after all others.
Repeated rows count each for itself; they share a hash and are told apart by a row number. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.flow import route
from quillspark.llm.store import written
from quillspark.operators.indexing import with_row_index

#: Of the query: weights repeat over the sources in order; words of the mix against all words; copies of a document at most.
WEIGHTS, SHARE, COPIES, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Hash bits of each of the two rounds that find where a pattern's words run out.
BITS = 12
#: Hex digits of a document's hash; few enough for a positive long.
HEX = 15
#: Overlapping patterns that the driver may hold, and rows of a table of patterns that is broadcast.
MAX_PATTERNS = 50_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def level_targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = COPIES) -> list[float]:
    """Targets in proportion to the weights, none above ``most`` times its size; what is cut off goes to the others by weight."""
    total, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = total / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        for i in over or open_:
            out[i] = most * sizes[i] if over else weights[i] * unit
        if not over:
            break
        total -= sum(most * sizes[i] for i in over)
        open_ -= set(over)
        total = max(total, 0.0)
    return out


def level_wants(held: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = COPIES) -> DataFrame:
    """(source, want): ``level_targets`` of a table (source, held) of any length, weights repeating over the sources by code point, null
    last. What is cut off at a level decides the next level, so a round is one sum over the sources."""
    at = with_row_index(held.withColumn("last", F.col("source").isNull()), ["last", "source"])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("row_idx") % len(weights) + 1).cast("int"))
    t = written(at.select("source", "held", weight.alias("weight")), "sources")
    unit, closed = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(unit) > F.lit(float(most)) * F.col("held")
        sums = t.agg(F.sum("held"), F.sum(F.when(over, F.col("held"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if sums[3] == closed or not sums[2]:
            break
        unit, closed = max(share * sums[0] - most * (sums[1] or 0), 0.0) / sums[2], sums[3]
    return t.select("source", F.when(over, F.lit(float(most)) * F.col("held")).otherwise(F.col("weight") * F.lit(unit)).alias("want"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_PATTERNS else df


def _quota_cut(sized: DataFrame, quota: DataFrame, rows: int) -> DataFrame:
    """(pattern, h, row) up to which each pattern's documents are taken whole once more, and ``left`` words for the next one.

    ``quota``: (pattern, want), of ``rows`` rows. Two rounds of range sums, then the order inside the last range."""
    inside, spare = sized.join(_sized(quota, rows), "pattern"), "want"
    for step in (1, 2):
        bucket = F.shiftright("h", 4 * HEX - BITS * step)
        sums = inside.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.max(spare).alias("spare"))
        before = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        at = sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= spare and spare < before + words")
        at = at.select(F.col("pattern").alias("p"), F.col("bucket").alias("b"), (F.col("spare") - F.col("before")).alias(f"spare{step}"))
        inside = inside.withColumn("b0", bucket).join(_sized(at, rows), (F.col("p") == F.col("pattern")) & (F.col("b") == F.col("b0"))).drop("p", "b", "b0")
        spare = f"spare{step}"
    run = F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1))
    last = inside.withColumn("before", F.coalesce(run, F.lit(0))).where(f"before <= {spare} and {spare} < before + size")
    return last.select("pattern", F.col("h").alias("cut_h"), F.col("row").alias("cut_row"), (F.col(spare) - F.col("before")).alias("left"))


def _flow_totals(spark, patterns: DataFrame, wants: DataFrame, links: DataFrame, copies: int) -> DataFrame:
    """(pattern, total) of all patterns: words that they give, repetitions counted."""
    crowded = links.where("n > 1").select("source").distinct()
    shared = links.join(crowded.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left_semi").select("pattern").distinct()
    rows = links.join(shared, "pattern").join(wants.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).groupBy("pattern", "words").agg(
        F.sort_array(F.collect_list(F.struct(F.col("s").isNull().alias("last"), F.coalesce("s", F.lit("")).alias("s"), "want"))).alias("of")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns of sources that overlap")
    rows.sort(key=lambda r: [(x["last"], x["s"]) for x in r["of"]])
    quota = {(x["last"], x["s"]): round(x["want"]) for r in rows for x in r["of"]}
    at = {s: i for i, s in enumerate(sorted(quota))}
    flows = route([r["words"] for r in rows], [quota[s] for s in sorted(quota)], [[at[x["last"], x["s"]] for x in r["of"]] for r in rows], copies)
    routed = spark.createDataFrame([(r["pattern"], sum(map(sum, f.values()))) for r, f in zip(rows, flows)], "pattern long, total long")
    alone = links.join(shared, "pattern", "left_anti").join(wants.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return alone.select("pattern", F.least(F.rint("want").cast("long"), F.col("words") * copies).alias("total")).unionAll(routed)


def mix(docs: DataFrame, members: Column, size: Column, quotas: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", copies: int = COPIES, seed: str = SEED) -> DataFrame:
    """(row, doc_id, members, size, source_size, target, taken) of every row.

    ``members``: array of the sources that a document is in (a null element is the null source). ``quotas``: (source, held: words
    of all documents in it) to (source, want: words wanted). ``source_size`` is the words of the pattern, ``target`` what its
    sources want together. Rows without an id are spread by their row number."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.sort_array(F.array_distinct(members), asc=False).alias("members"), size.alias("size"), F.col(id_col).cast("string").alias("name"))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("name", F.concat(F.lit("row:"), F.col("row").cast("string"))))), 1, HEX), 16, 10).cast("long")
    sized = written(rows.select("row", "doc_id", "members", "size", h.alias("h")), "sized")
    patterns = written(sized.groupBy("members").agg(F.sum("size").alias("words")).select(F.monotonically_increasing_id().alias("pattern"), "members", "words"), "patterns")
    links = patterns.select("pattern", "words", F.size("members").alias("n"), F.explode("members").alias("source"))
    wants = written(quotas(links.groupBy("source").agg(F.sum("words").alias("held"))), "wants")
    totals = _flow_totals(spark, patterns, wants, links, copies)
    target = links.join(wants.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).groupBy("pattern").agg(F.sum("want").alias("target"))
    times = F.when(F.col("words") > 0, F.floor(F.col("total") / F.col("words")).cast("long")).otherwise(F.lit(0).cast("long"))
    plan = patterns.join(totals, "pattern").join(target, "pattern").select("pattern", F.col("members").alias("pm"), F.col("words").alias("source_size"), "target", times.alias("times"), "total")
    plan = written(plan.select("pattern", "pm", "source_size", "target", "times", (F.col("total") - F.col("times") * F.col("source_size")).alias("want")), "plan")
    n = plan.count()
    marked = sized.join(_sized(plan, n), F.col("members").eqNullSafe(F.col("pm"))).drop("pm")
    cut = _quota_cut(marked.select("pattern", "h", "row", "size"), plan.select("pattern", "want"), n)
    out = marked.join(_sized(cut, n), "pattern", "left")
    more = F.when(F.struct("h", "row") < F.struct("cut_h", "cut_row"), F.col("size")).when(F.col("row") == F.col("cut_row"), F.col("left")).otherwise(0)
    return out.select("row", "doc_id", "members", "size", "source_size", "target", (F.col("size") * F.col("times") + F.coalesce(more, F.lit(0))).alias("taken"))


def query_quotas(weights=WEIGHTS, share: float = SHARE, most: int = COPIES):
    """Quotas by weights that repeat over the sources in order."""
    return lambda held: level_wants(held, weights, share, most)
