"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

1. Base: the given patterns for e-mail addresses, IP addresses, card and phone numbers; a match that fails its check is dropped.
2. Candidates: white-space tokens with a digit or an at sign, without surrounding punctuation. Their lexical contexts are
   patterns: the two words before, whatever they are (an earlier candidate counts as its shape), and the word before with the token's shape.
3. Seeds are the base entities. Over the graph of patterns and instances (distinct values), in turn: a pattern's confidence for a kind
   is the share of its instances that are known to be of that kind; an instance is accepted for a kind when the patterns around it leave at most
   ``1 - ACCEPT`` doubt (noisy or), of patterns with at least ``SUPPORT`` known instances and ``TRUST`` confidence. Accepted instances
   are known in the next round. Known instances only become more, and the rounds end when none is added.
4. Each occurrence of an accepted instance in a trusted pattern is added as a span; base spans always stay.

Instances and patterns are counted by Spark, combined before each shuffle; texts are read once. Null texts count as empty and have no
spans. Repeated rows and ids are rows of their own, and repeat their values, which count once. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.store import written

#: In the order of the result. A match begins at the begin of a run of its characters or where the last match ended, and inner runs
#: are taken whole; both give the same matches as the plain patterns, in time linear in the text.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SUPPORT, TRUST, ACCEPT = 3, 0.8, 0.9
#: Elements that are summed by appending.
BLOCK = 64
#: Longest pattern that is its own key; of a longer one its digest is.
KEY = 64

_SPAN = "array<struct<s:int,e:int,v:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(lengths: Column, levels: int = 2) -> Column:
    """Running sums of an array of ints, without the element itself. An append copies what it appends to, so only blocks of ``BLOCK``
    elements are summed by appending; the blocks' sums are summed in the same way."""
    if not levels:
        zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")), lambda a: a["out"])

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return _let(_starts(sums, levels - 1), lambda before: F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before.alias("f")), lambda z: F.transform(_starts(z["b"], 0), lambda x: x + z["f"]))))

    last = F.floor((F.size(lengths) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(lengths, i * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(_let(blocks, of_blocks))


def _shape(c: Column) -> Column:
    """Letters as one ``a``, digits as one ``9``."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}+", "a"), "[0-9]+", "9")


def _last_words(c: Column) -> tuple[Column, Column]:
    """The last word of a text whose white space is blanks, and the one before it (empty: none)."""
    whole = F.rtrim(c)
    last = F.substring_index(whole, " ", -1)
    return last, F.substring_index(F.rtrim(F.left(whole, F.length(whole) - F.length(last))), " ", -1)


def _words_before(pairs: Column, i: Column) -> Column:
    """The two words before match i of (p: text before, m: match), an earlier match as its shape: found among the match before the last
    one, the last word after it, the last match and the last two words after that."""

    def blanks(x: Column) -> Column:
        return F.translate(x, "\t\n\r\x0b\x0c", "     ")

    def at(k: int, field: str) -> Column:
        return F.coalesce(F.when(i >= k, F.get(pairs, F.when(i >= k, i - k).otherwise(0))[field]), F.lit(""))

    last, second = _last_words(blanks(at(0, "p")))
    earlier = F.when(second != "", F.lit("")).otherwise(F.concat_ws(" ", _shape(at(2, "m")), _last_words(blanks(at(1, "p")))[0], _shape(at(1, "m"))))
    one, two = _last_words(F.concat_ws(" ", earlier, second, last))
    return F.trim(F.concat_ws(" ", two, one))


def _matches(text: Column, pattern: str, context: bool = False) -> Column:
    """All matches as (s, e, v), offsets in code points; with ``context`` also the two words before. Work is in proportion to the text."""
    pieces = F.split(text, pattern, -1).alias("p")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")

    def of_pairs(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))

        def span(z: Column, i: Column) -> Column:
            s = z["f"] + F.length(z["x"]["p"])
            own = [s.alias("s"), (s + F.length(z["x"]["m"])).alias("e"), z["x"]["m"].alias("v")] + ([_words_before(pairs, i).alias("b")] if context else [])
            return F.struct(*own)

        spans = F.transform(F.arrays_zip(pairs.alias("x"), _starts(lengths).alias("f")), span)
        return F.filter(spans, lambda x: x["v"].isNotNull())

    return _let(F.arrays_zip(pieces, found), of_pairs)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    digits = F.split(F.reverse(_digits(v)), "")
    numbers = F.transform(F.filter(digits, lambda x: x != ""), lambda x: x.cast("int"))
    values = F.transform(numbers, lambda x, i: F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(v))
    return {"email": F.lit(True), "card": n.between(13, 19) & F.when(n.between(13, 19), _luhn(v)).otherwise(False), "phone": n.between(9, 15)}[kind]


def base_spans(text: Column, kind: str) -> Column:
    """Checked matches of one kind as (s, e, v)."""
    some = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(r"[0-9]\." if kind == "ip" else "[0-9]")
    return F.when(some, F.filter(_matches(text, KINDS[kind]), lambda x: _passes(kind, x["v"]))).otherwise(F.array().cast(_SPAN))


def _trimmed(c: Column) -> Column:
    """A candidate without surrounding punctuation, with the last two words before it."""
    lead = F.length(F.regexp_extract(c["v"], r"^[\p{Punct}&&[^+]]*", 0))
    value = F.regexp_replace(F.regexp_replace(c["v"], r"^[\p{Punct}&&[^+]]++", ""), r"\p{Punct}++$", "")
    return F.struct((c["s"] + lead).alias("s"), (c["s"] + lead + F.length(value)).alias("e"), value.alias("v"), F.lower(c["b"]).alias("before"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row, doc_id, base spans of each kind, candidates (s, e, v, before)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    candidates = F.when(text.rlike("[0-9@]"), F.transform(_matches(text, CANDIDATE, context=True), _trimmed)).otherwise(F.array().cast(_SPAN[:-2] + ",before:string>>"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), *(base_spans(text, k).alias(k) for k in KINDS), candidates.alias("candidates"))
    return written(rows, "scanned")


def _of_kinds() -> Column:
    """The base spans of all kinds as one array of (k: number of the kind, s, e, v)."""

    def own(kind: str) -> Column:
        number = F.lit(list(KINDS).index(kind))
        return F.transform(kind, lambda x: F.named_struct(F.lit("k"), number, F.lit("s"), x["s"], F.lit("e"), x["e"], F.lit("v"), x["v"]))

    return F.concat(*map(own, KINDS))


def occurrences(scan: DataFrame) -> DataFrame:
    """(row, s, e, value, kind of the first base span that begins in it or null, pattern) of every candidate that is no later part of a
    base span. Candidates and base spans of a text pass by in order of their begins, in one stream; none meets all others."""
    some = scan.where(F.size("candidates") > 0)
    base = some.select("row", F.explode(_of_kinds()).alias("b")).select("row", "b.s", "b.e", "b.v", "b.k", F.lit(None).cast("string").alias("before"))
    found = some.select("row", F.explode("candidates").alias("c")).select("row", "c.s", "c.e", "c.v", F.lit(None).cast("int").alias("k"), "c.before").where(F.length("v") > 0)
    so_far = Window.partitionBy("row").orderBy("s", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.last(F.when(F.col("k").isNull(), F.struct("s", "e")), ignorenulls=True).over(so_far).alias("own")
    past = F.max(F.when(F.col("k").isNotNull(), F.col("e"))).over(so_far).alias("past")
    marked = base.unionAll(found).select("*", own, past).where("s < own.e")
    first = F.min(F.when(F.col("k").isNotNull(), F.struct("k", "s", "v")))
    of = lambda c: F.max(F.when(F.col("k").isNull(), F.col(c)))
    rows = marked.groupBy("row", F.col("own.s").alias("start")).agg(F.struct(F.max("own.s").alias("s"), F.max("own.e").alias("e"), of("v").alias("v"), of("before").alias("before")).alias("c"), of("past").alias("past"), first.alias("hit"))
    rows = rows.where("past is null or past <= start")
    shape = _shape(F.col("c.v"))
    last = F.substring_index("c.before", " ", -1)
    patterns = F.array(F.when(F.contains(F.col("c.before"), F.lit(" ")), F.concat(F.lit("2:"), "c.before")), F.when(last != "", F.concat_ws(":", F.lit("1"), last, shape)))
    out = rows.select("row", F.col("c.s").alias("s"), F.col("c.e").alias("e"), F.coalesce("hit.v", "c.v").alias("value"), F.col("hit.k").alias("kind"), F.explode(patterns).alias("pattern"))
    return out.where("pattern is not null").withColumn("pattern", F.when(F.length("pattern") > KEY, F.md5("pattern")).otherwise(F.col("pattern")))


def discovered(occ: DataFrame, support: int = SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """(row, kind, s, e) of the occurrences that the patterns add."""
    # a value is known by its kind wherever it stands; one that is of several kinds counts for its first
    occ = written(occ, "contexts")
    links = written(occ.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "pattern-links")
    known = links.where("kind is not null").groupBy("value").agg(F.min("kind").alias("known"))
    known = written(known, "known")
    size, before = known.count(), -1
    while size != before:
        marked = links.select("pattern", "value").join(known, "value", "left")
        kinds = marked.groupBy("pattern", "known").agg(F.count("*").alias("n"))
        total = kinds.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(F.when(F.col("known").isNotNull(), F.struct("n", F.col("known").alias("kind")))).alias("top"))
        trusted = written(total.where((F.col("top.n") >= support) & (F.col("top.n") >= trust * F.col("all"))).select("pattern", "top.kind", (F.col("top.n") / F.col("all")).alias("confidence")), "trusted")
        doubt = links.select("pattern", "value").join(trusted, "pattern").groupBy("value", "kind").agg(F.sum(F.log1p(-F.least("confidence", F.lit(0.95)))).alias("doubt"))
        new = doubt.where(F.col("doubt") <= F.log(F.lit(1 - accept + 1e-9))).groupBy("value").agg(F.min(F.struct("doubt", "kind"))["kind"].alias("found"))
        known = written(known.join(new, "value", "full").select("value", F.coalesce("known", "found").alias("known")), "known")
        size, before = known.count(), size
    found = occ.where("kind is null").drop("kind").join(trusted, "pattern").join(known, "value").where("known = kind")
    return found.select("row", "kind", "s", "e").distinct()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base: (kind, s, e) in order, spans: the same with what was discovered) of every row."""
    scan = scanned(docs, id_col, text_col)
    base = F.transform(_of_kinds(), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    added = discovered(occurrences(scan)).groupBy("row").agg(F.collect_list(F.struct(F.col("kind").alias("k"), "s", "e")).alias("added"))
    out = scan.select("row", "doc_id", *KINDS, base.alias("base")).join(added, "row", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast("array<struct<k:int,s:int,e:int>>"))))  # what is added overlaps no base span
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sort_array("base").alias("base"), spans.alias("spans"))


def span_text(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
