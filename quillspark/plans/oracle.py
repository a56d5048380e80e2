"""SQL oracles (DuckDB dialect) for the registered queries, same keys and column names.

Fragments are shared so that every oracle derives its inputs by the same fixture rules.
"""

from __future__ import annotations

from quillspark.functions.text import TOKEN_PATTERN

ORACLE: dict[str, str] = {}


def tok(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TOKEN_PATTERN}')"


def ttr(lst: str, window: int = 128) -> str:
    h = f"list_slice({lst}, 1, {window})"
    return f"(CASE WHEN len({h}) = 0 THEN 0.0 ELSE len(list_distinct({h})) / len({h}) END)"


def z_of(lst: str) -> str:
    return f"(8.0 * ({ttr(lst)} - 0.45))"


IDX = """idx AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS filename, d.source AS prompt, d.lang AS language,
         CASE WHEN l.toxic = 1 THEN 'low' WHEN l.quality = 1 THEN 'high' ELSE 'medium' END AS score_level
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

ESSAY = IDX + f""",
essay_tok AS (
  SELECT i.filename, {tok('d.text')} AS tokens
  FROM idx i JOIN documents d ON i.filename = CAST(d.doc_id AS VARCHAR)),
essay_f AS (SELECT filename, list_slice(tokens, 1, 128) AS t FROM essay_tok WHERE len(tokens) >= 128),
essay_sc AS (
  SELECT filename, 1.0 / (1.0 + exp({z_of('t')})) AS fake, 1.0 / (1.0 + exp(0.0 - {z_of('t')})) AS real
  FROM essay_f)"""


def essay_rows(t: float) -> str:
    return ESSAY + f""",
essay_rows AS (
  SELECT i.*, s.real, CAST(s.real > {t} AS INTEGER) AS correct
  FROM idx i JOIN essay_sc s ON i.filename = s.filename)"""


REVIEWS = f"""rev AS (
  SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS url,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS singleparent_share2010,
         {ttr(tok('text'))} AS perwht,
         CAST(doc_id % 4 AS VARCHAR) AS urbanicity,
         CAST(1.0 / (1.0 + exp(0.0 - {z_of(f"list_slice({tok('text')}, 1, 128)")})) > 0.5 AS INTEGER) AS correct
  FROM documents)"""

LABELLED = f"""corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 1 AS label, {tok('text')} AS tokens FROM documents
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 0 AS label, {tok('text')} AS tokens
  FROM conversations WHERE role = 'assistant'),
logits AS (SELECT id, label, tokens, 0.0 AS l_fake, {z_of('tokens')} AS l_real FROM corpus)"""

ORACLE["flagship_cohort_accuracy"] = "WITH " + ESSAY + """,
th AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.94::DOUBLE)) v(threshold)),
dec AS (SELECT th.threshold, s.filename, s.real > th.threshold AS correct FROM essay_sc s CROSS JOIN th)
SELECT dec.threshold, i.score_level, count(dec.correct) AS n,
       round(avg(CAST(dec.correct AS INTEGER)), 6) AS accuracy
FROM idx i JOIN dec ON i.filename = dec.filename
GROUP BY dec.threshold, i.score_level"""

ORACLE["A1_count_by"] = "WITH " + essay_rows(0.94) + """
SELECT score_level, count(correct) AS n FROM essay_rows WHERE score_level IS NOT NULL GROUP BY score_level"""

ORACLE["A2_mean_by"] = "WITH " + REVIEWS + """
SELECT urbanicity, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM rev GROUP BY urbanicity"""

ORACLE["A3_profile_by"] = "WITH " + essay_rows(0.94) + """
SELECT language, count(filename) AS n_filename, count(prompt) AS n_prompt, count(score_level) AS n_score_level,
       count(real) AS n_real, round(avg(real), 6) AS mean_real,
       count(correct) AS n_correct, round(avg(CAST(correct AS DOUBLE)), 6) AS mean_correct
FROM essay_rows GROUP BY language"""

ORACLE["A4_above_mean"] = "WITH " + REVIEWS + """,
m AS (SELECT avg(singleparent_share2010) AS m1, avg(perwht) AS m2 FROM rev),
b AS (SELECT rev.*, coalesce(singleparent_share2010 > m.m1, false) AS a1, coalesce(perwht > m.m2, false) AS a2
      FROM rev CROSS JOIN m)
SELECT 'singleparent_share2010' AS covariate, a1 AS above, count(correct) AS n,
       round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM b GROUP BY a1
UNION ALL
SELECT 'perwht' AS covariate, a2 AS above, count(correct) AS n,
       round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM b GROUP BY a2"""

CROSSTAB = """ct AS (
  SELECT score_level, count_if(correct = 0) AS correct_0, count_if(correct = 1) AS correct_1
  FROM essay_rows WHERE score_level IS NOT NULL GROUP BY score_level)"""

ORACLE["A5_crosstab"] = "WITH " + essay_rows(0.94) + ",\n" + CROSSTAB + "\nSELECT * FROM ct"


def lnc(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1) - lgamma(({k}) + 1) - lgamma(({n}) - ({k}) + 1))"


ORACLE["A6_fisher_pairs"] = "WITH " + essay_rows(0.94) + ",\n" + CROSSTAB + f""",
pairs AS (SELECT * FROM (VALUES ('high-medium', 'high', 'medium'), ('medium-low', 'low', 'medium'),
                                ('high-low', 'high', 'low')) v(pair, first, second)),
t AS (
  SELECT p.pair, CAST(coalesce(r1.correct_0, 0) AS BIGINT) AS a, CAST(coalesce(r1.correct_1, 0) AS BIGINT) AS b,
         CAST(coalesce(r2.correct_0, 0) AS BIGINT) AS c, CAST(coalesce(r2.correct_1, 0) AS BIGINT) AS d
  FROM pairs p LEFT JOIN ct r1 ON r1.score_level = p.first LEFT JOIN ct r2 ON r2.score_level = p.second),
m AS (SELECT *, a + b AS n1, c + d AS n2, a + c AS k FROM t),
e AS (SELECT *, (n1 = 0 OR n2 = 0 OR k = 0 OR n1 + n2 = k) AS empty,
             {lnc('n1', 'a')} + {lnc('n2', 'k - a')} - {lnc('n1 + n2', 'k')} AS lp_obs FROM m),
xs AS (SELECT pair, n1, n2, k, lp_obs, unnest(generate_series(greatest(0, k - n2), least(k, n1))) AS x
       FROM e WHERE NOT empty),
lp AS (SELECT pair, lp_obs, {lnc('n1', 'x')} + {lnc('n2', 'k - x')} - {lnc('n1 + n2', 'k')} AS lp FROM xs),
s AS (SELECT pair, sum(CASE WHEN lp <= lp_obs + 1e-7 THEN exp(lp) ELSE 0.0 END) AS psum FROM lp GROUP BY pair)
SELECT e.pair, e.a, e.b, e.c, e.d,
       round(CASE WHEN empty THEN 'nan'::DOUBLE WHEN b * c = 0 THEN 'inf'::DOUBLE
                  ELSE CAST(a * d AS DOUBLE) / CAST(b * c AS DOUBLE) END, 6) AS odds_ratio,
       round(CASE WHEN empty THEN 1.0 ELSE least(1.0, s.psum) END, 6) AS p_value
FROM e LEFT JOIN s ON e.pair = s.pair"""

ORACLE["A7_std_by"] = "WITH " + essay_rows(0.94) + """
SELECT score_level, round(stddev_samp(CAST(correct AS DOUBLE)), 6) AS std FROM essay_rows GROUP BY score_level"""

ORACLE["A8_ttest_pairs"] = "WITH " + essay_rows(0.5) + """,
g AS (SELECT score_level, count(correct) AS n, avg(CAST(correct AS DOUBLE)) AS m,
             var_samp(CAST(correct AS DOUBLE)) AS v FROM essay_rows GROUP BY score_level),
pairs AS (SELECT * FROM (VALUES ('high-medium', 'high', 'medium'), ('medium-low', 'medium', 'low'),
                                ('high-low', 'high', 'low')) v(pair, g1, g2)),
tt AS (SELECT p.pair, (s1.m - s2.m) / sqrt(((s1.n - 1) * s1.v + (s2.n - 1) * s2.v) / (s1.n + s2.n - 2) * (1.0 / s1.n + 1.0 / s2.n)) AS t,
       CAST(s1.n + s2.n - 2 AS BIGINT) AS dof
FROM pairs p JOIN g s1 ON s1.score_level = p.g1 JOIN g s2 ON s2.score_level = p.g2),
-- the finite sums of Student's distribution for whole degrees of freedom
th AS (SELECT *, atan(abs(t) / sqrt(dof)) AS th FROM tt),
js AS (SELECT pair, dof, th, unnest(range(0, dof // 2)) AS j FROM th WHERE dof > 1),
sm AS (SELECT pair, sum(CASE WHEN dof % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * cos(th) ** (2 * j)
                             ELSE exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) * cos(th) ** (2 * j + 1) END) AS s FROM js GROUP BY pair)
SELECT pair, round(t, 6) AS t, dof,
       round(CASE WHEN dof <= 0 OR t IS NULL THEN NULL WHEN dof % 2 = 0 THEN 1 - sin(th) * s ELSE 1 - 2 / pi() * (th + sin(th) * coalesce(s, 0)) END, 6) AS p_value
FROM th LEFT JOIN sm USING (pair)"""

ORACLE["A9_chisq"] = "WITH " + essay_rows(0.5) + ",\n" + CROSSTAB + """,
tot AS (SELECT sum(correct_0) AS c0, sum(correct_1) AS c1, count(*) AS levels FROM ct
        WHERE correct_0 + correct_1 > 0),
cells AS (
  SELECT ct.correct_0 AS o, (ct.correct_0 + ct.correct_1) * tot.c0 / (tot.c0 + tot.c1) AS ex FROM ct, tot
  UNION ALL
  SELECT ct.correct_1 AS o, (ct.correct_0 + ct.correct_1) * tot.c1 / (tot.c0 + tot.c1) AS ex FROM ct, tot),
st AS (SELECT sum((o - ex) * (o - ex) / ex) AS statistic FROM cells)
SELECT round(st.statistic, 6) AS statistic, CAST(tot.levels - 1 AS BIGINT) AS dof,
       round(CASE WHEN tot.levels = 3 THEN exp(-st.statistic / 2) END, 6) AS p_value
FROM st, tot"""

ORACLE["A11_corpus_report"] = "WITH " + LABELLED + """
SELECT CASE WHEN label = 1 THEN 'real' ELSE 'generated' END AS origin, count(*) AS rows,
       CAST(sum(len(tokens)) AS BIGINT) AS tokens, round(avg(len(tokens)), 6) AS mean_len,
       CAST(max(len(tokens)) AS BIGINT) AS max_len, CAST(min(len(tokens)) AS BIGINT) AS min_len
FROM corpus GROUP BY 1"""

ORACLE["D1_softmax"] = "WITH " + ESSAY + "\nSELECT filename, round(fake, 6) AS fake, round(real, 6) AS real FROM essay_sc"

ORACLE["D2_argmax"] = "WITH " + LABELLED + """
SELECT id, label, CASE WHEN l_real > l_fake THEN 1 ELSE 0 END AS pred,
       (CASE WHEN l_real > l_fake THEN 1 ELSE 0 END) = label AS correct FROM logits"""

ORACLE["D3_correct_rule"] = "WITH " + LABELLED + """,
p AS (SELECT id, label, 1.0 / (1.0 + exp(l_real - l_fake)) AS fake, 1.0 / (1.0 + exp(l_fake - l_real)) AS real
      FROM logits)
SELECT id, label, round(fake, 6) AS fake, round(real, 6) AS real,
       (real > fake AND label = 1) OR (fake > real AND label = 0) AS correct FROM p"""

ORACLE["D4_threshold"] = "WITH " + ESSAY + """
SELECT filename, th.threshold, real > th.threshold AS correct
FROM essay_sc CROSS JOIN (VALUES (0.5::DOUBLE), (0.94::DOUBLE)) th(threshold)"""

NLL = """(greatest(l_fake, l_real) + ln(exp(l_fake - greatest(l_fake, l_real)) + exp(l_real - greatest(l_fake, l_real)))
         - CASE WHEN label = 1 THEN l_real ELSE l_fake END)"""

ORACLE["D5_cross_entropy"] = "WITH " + LABELLED + f"\nSELECT round(avg({NLL}), 6) AS loss FROM logits"

ORACLE["D6_epoch_metrics"] = "WITH " + LABELLED + f""",
r AS (SELECT *, (row_number() OVER (ORDER BY label, id) - 1) // 32 AS batch_id,
             {NLL} AS loss, CAST((CASE WHEN l_real > l_fake THEN 1 ELSE 0 END) = label AS INTEGER) AS acc FROM logits),
b AS (SELECT batch_id, avg(loss) AS b_loss, avg(acc) AS b_acc, sum(loss) AS s_loss, sum(acc) AS s_acc,
             count(*) AS n FROM r GROUP BY batch_id)
SELECT round(avg(b_loss), 6) AS avg_loss, round(avg(b_acc), 6) AS avg_acc,
       round(sum(s_loss) / sum(n), 6) AS row_loss, round(sum(s_acc) / sum(n), 6) AS row_acc,
       count(*) AS n_batches FROM b"""

ORACLE["D7_last_write"] = f"""WITH c AS (
  SELECT CAST(conv_id AS VARCHAR) AS id, turn, {z_of(tok('text'))} AS z FROM conversations),
l AS (SELECT id, arg_max(turn, turn) AS turn, arg_max(z, turn) AS z FROM c GROUP BY id)
SELECT id, turn, round(1.0 / (1.0 + exp(z)), 6) AS fake, round(1.0 / (1.0 + exp(0.0 - z)), 6) AS real FROM l"""

ORACLE["D10_lexical_score"] = f"""SELECT doc_id, 0.0 AS l_fake, round({z_of(tok('text'))}, 6) AS l_real FROM documents"""
