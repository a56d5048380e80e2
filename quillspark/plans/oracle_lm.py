"""SQL oracles for the n-gram model tables, losses and perplexity."""

from __future__ import annotations

from quillspark.functions.text import PY_SPACE
from quillspark.plans.oracle import ORACLE, tok
from quillspark.plans.oracle_tokens import LM_SPLIT, chunks

LM = f"""{LM_SPLIT},
ch0 AS (SELECT doc_id, split, {chunks(tok('text'), 256)} AS ch FROM sp),
ch AS (SELECT doc_id, split, unnest(ch) AS chunk, unnest(range(len(ch))) AS chunk_idx FROM ch0),
pr0 AS (SELECT doc_id, chunk_idx, split, unnest(list_concat(['<s>'], list_slice(chunk, 1, len(chunk) - 1))) AS ctx,
               unnest(chunk) AS tok FROM ch),
pr AS (SELECT * FROM pr0 WHERE tok IS NOT NULL),
big AS (SELECT ctx, tok, count(*) AS n FROM pr WHERE split = 'train' GROUP BY ctx, tok),
cx AS (SELECT ctx, sum(n) AS ctx_n FROM big GROUP BY ctx),
uni AS (SELECT tok, count(*) AS u FROM pr WHERE split = 'train' GROUP BY tok),
st AS (SELECT sum(u) AS nn, count(*) AS vv FROM uni)"""

PROB = "(coalesce(b.n, 0) + 1.0 * ((coalesce(u.u, 0) + 1) / (st.nn + st.vv + 1))) / (coalesce(c.ctx_n, 0) + 1.0)"

LOSSES = LM + f""",
vp AS (SELECT doc_id, chunk_idx, ctx, tok, count(*) AS m FROM pr WHERE split = 'valid' GROUP BY doc_id, chunk_idx, ctx, tok),
sc AS (SELECT vp.*, {PROB} AS p FROM vp LEFT JOIN big b ON vp.ctx = b.ctx AND vp.tok = b.tok
       LEFT JOIN cx c ON vp.ctx = c.ctx LEFT JOIN uni u ON vp.tok = u.tok CROSS JOIN st),
cl AS (SELECT doc_id, chunk_idx, sum(m) AS n_tokens, sum(m * -ln(p)) AS loss_sum FROM sc GROUP BY doc_id, chunk_idx)"""

ORACLE["M1_ngram_fit"] = f"""WITH {LM}
SELECT big.ctx, big.tok, CAST(big.n AS BIGINT) AS n, CAST(cx.ctx_n AS BIGINT) AS ctx_n FROM big JOIN cx ON big.ctx = cx.ctx"""

ORACLE["M2_ngram_loss"] = f"""WITH {LOSSES}
SELECT doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, CAST(n_tokens AS BIGINT) AS n_tokens,
       round(loss_sum / n_tokens, 6) AS loss FROM cl"""

PIECES = f"""w AS (SELECT {chunks(tok('text'), 256)} AS ch, len(string_split(regexp_replace(text, '\\A[{PY_SPACE}]+|[{PY_SPACE}]+\\z', '', 'g'), ' ')) AS orig
      FROM sp WHERE split = 'valid'),
cnt AS (SELECT sum(list_sum(list_transform(ch, lambda c: len(c)))) AS n_tokens, sum(orig) AS n_orig FROM w)"""

METRICS = f"""{LOSSES},
r AS (SELECT *, (row_number() OVER (ORDER BY doc_id, chunk_idx) - 1) // 4 AS batch_id FROM cl),
bl AS (SELECT batch_id, sum(loss_sum) / sum(n_tokens) AS loss FROM r GROUP BY batch_id),
{PIECES},
m AS (SELECT avg(loss) AS loss FROM bl),
a10 AS (SELECT 'valid' AS split, round(m.loss, 6) AS loss, round(exp(m.loss), 6) AS ppl,
       round(exp(m.loss * (cnt.n_tokens - 1) / (cnt.n_orig - 1)), 6) AS adjusted_ppl FROM m, cnt)"""

ORACLE["A10_perplexity"] = f"WITH {METRICS} SELECT * FROM a10"

ORACLE["M3_decode_filter"] = f"""WITH {LM},
bt AS (SELECT b.ctx, b.tok, ln({PROB}) AS l FROM big b JOIN cx c ON b.ctx = c.ctx LEFT JOIN uni u ON b.tok = u.tok
       CROSS JOIN st),
pen AS (SELECT ctx, tok, (CASE WHEN tok = ctx THEN (CASE WHEN l < 0 THEN l * 1.2 ELSE l / 1.2 END) ELSE l END) / 0.8 AS l
        FROM bt),
tk AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY ctx ORDER BY l DESC) AS r FROM pen) WHERE r <= 40),
e AS (SELECT ctx, tok, l, exp(l - max(l) OVER (PARTITION BY ctx)) AS e FROM tk),
p1 AS (SELECT ctx, tok, l, e / sum(e) OVER (PARTITION BY ctx) AS prob FROM e),
cu AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY ctx ORDER BY l DESC, tok
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p1),
kept AS (SELECT ctx, tok, prob FROM cu WHERE before <= 0.96)
SELECT ctx, tok, round(prob / sum(prob) OVER (PARTITION BY ctx), 6) AS prob FROM kept"""

BEST = """best AS MATERIALIZED (SELECT ctx, tok FROM (SELECT b.ctx, b.tok, row_number() OVER (
           PARTITION BY b.ctx ORDER BY b.n + (u.u + 1) / (st.nn + st.vv + 1) DESC, b.tok) AS r
         FROM big b JOIN uni u ON b.tok = u.tok CROSS JOIN st) WHERE r = 1)"""

ORACLE["M6_greedy_sample"] = f"""WITH RECURSIVE {LM},
{BEST},
p0 AS (SELECT CAST(doc_id AS VARCHAR) AS id, {tok(f"regexp_extract(text, '[^{PY_SPACE}]+', 0)")} AS toks FROM documents),
g AS (SELECT id, toks FROM p0 WHERE len(toks) > 0
      UNION ALL
      SELECT g.id, list_append(g.toks, best.tok) FROM g JOIN best ON g.toks[-1] = best.ctx WHERE len(g.toks) < 32)
SELECT id, array_to_string(arg_max(toks, len(toks)), ' ') AS text FROM g GROUP BY id"""

# whole-number mass of every candidate, the nucleus, and the ranges of draws cut into cells (one row for each cell a range touches)
CELLS = f"""{LM},
wm AS (SELECT b.ctx, b.tok, b.n::HUGEINT * (st.nn + st.vv + 1) + u.u + 1 AS w FROM big b JOIN uni u ON b.tok = u.tok CROSS JOIN st),
wb AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY ctx ORDER BY w DESC, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(w) OVER (PARTITION BY ctx) AS total FROM wm),
wk AS (SELECT ctx, tok, w FROM wb WHERE before * 1000000 <= total * 960000),
wc AS (SELECT ctx, tok, w, sum(w) OVER (PARTITION BY ctx ORDER BY w DESC, tok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top,
              sum(w) OVER (PARTITION BY ctx) AS total, count(*) OVER (PARTITION BY ctx) AS followers FROM wk),
rg AS (SELECT ctx, tok, followers, (((top - w) * 4294967296 + total - 1) // total)::BIGINT AS lo, ((top * 4294967296 + total - 1) // total)::BIGINT AS hi FROM wc),
fo AS MATERIALIZED (SELECT DISTINCT ctx, followers FROM rg),
ce AS MATERIALIZED (SELECT ctx, tok, lo, hi, unnest(range((lo * followers) >> 32, (((hi - 1) * followers) >> 32) + 1)) AS cell FROM rg WHERE hi > lo)"""


def samples(prompts: str, length: int = 192) -> str:
    """Replays the draws; ``prompts``: (id, toks)."""
    return f"""WITH RECURSIVE {CELLS},
p0 AS ({prompts}),
g AS (SELECT id, 0 AS step, coalesce(toks[-1], '<s>') AS last, {length} - len(toks) AS steps FROM p0
      UNION ALL
      SELECT h.id, h.step + 1, ce.tok, h.steps
      FROM (SELECT g.*, fo.followers, ('0x' || substr(md5('42:' || id || ':0:' || step), 1, 8))::BIGINT AS u FROM g JOIN fo ON g.last = fo.ctx WHERE step < steps) h
      JOIN ce ON ce.ctx = h.last AND ce.cell = (h.u * h.followers) >> 32 AND h.u >= ce.lo AND h.u < ce.hi),
d AS (SELECT id, list(last ORDER BY step) FILTER (step > 0) AS drawn FROM g GROUP BY id)
SELECT p0.id, CAST(0 AS INTEGER) AS sample_idx, array_to_string(list_concat(p0.toks, coalesce(d.drawn, [])), ' ') AS text, CAST(42 AS BIGINT) AS seed
FROM p0 JOIN d ON p0.id = d.id"""


FIRST_WORDS = f"""SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS id, {tok(f"regexp_extract(text, '[^{PY_SPACE}]+', 0)")} AS toks FROM documents) WHERE len(toks) > 0"""
ORACLE["M4_generate"] = samples(FIRST_WORDS)
ORACLE["M5_generate_uncond"] = samples("SELECT CAST(doc_id AS VARCHAR) AS id, CAST([] AS VARCHAR[]) AS toks FROM sp WHERE split = 'valid'")

# the model after each of three shares of the training texts, all epochs side by side
ORACLE["K5_metric_log"] = f"""WITH RECURSIVE {LM},
ep AS (SELECT unnest(range(3)) AS epoch),
big_e AS (SELECT epoch, ctx, tok, count(*) AS n FROM pr JOIN ep ON doc_id % 3 <= epoch WHERE split = 'train' GROUP BY epoch, ctx, tok),
cx_e AS (SELECT epoch, ctx, sum(n) AS ctx_n FROM big_e GROUP BY epoch, ctx),
uni_e AS (SELECT epoch, tok, sum(n) AS u FROM big_e GROUP BY epoch, tok),
st_e AS (SELECT epoch, sum(u) AS nn, count(*) AS vv FROM uni_e GROUP BY epoch),
vp AS (SELECT doc_id, chunk_idx, ctx, tok, count(*) AS m FROM pr WHERE split = 'valid' GROUP BY doc_id, chunk_idx, ctx, tok),
sc AS (SELECT st.epoch, vp.*, {PROB} AS p FROM vp CROSS JOIN st_e st LEFT JOIN big_e b ON vp.ctx = b.ctx AND vp.tok = b.tok AND st.epoch = b.epoch
       LEFT JOIN cx_e c ON vp.ctx = c.ctx AND st.epoch = c.epoch LEFT JOIN uni_e u ON vp.tok = u.tok AND st.epoch = u.epoch),
cl AS (SELECT epoch, doc_id, chunk_idx, sum(m) AS n_tokens, sum(m * -ln(p)) AS loss_sum FROM sc GROUP BY epoch, doc_id, chunk_idx),
r AS (SELECT *, (row_number() OVER (PARTITION BY epoch ORDER BY doc_id, chunk_idx) - 1) // 4 AS batch_id FROM cl),
bl AS (SELECT epoch, batch_id, sum(loss_sum) / sum(n_tokens) AS loss FROM r GROUP BY epoch, batch_id),
m AS (SELECT epoch, avg(loss) AS loss FROM bl GROUP BY epoch),
{PIECES},
best AS MATERIALIZED (SELECT epoch, ctx, tok FROM (SELECT b.epoch, b.ctx, b.tok, row_number() OVER (
           PARTITION BY b.epoch, b.ctx ORDER BY b.n + (u.u + 1) / (st.nn + st.vv + 1) DESC, b.tok) AS r
         FROM big_e b JOIN uni_e u ON b.tok = u.tok AND b.epoch = u.epoch JOIN st_e st ON b.epoch = st.epoch) WHERE r = 1),
g AS (SELECT epoch, '<s>' AS last, CAST([] AS VARCHAR[]) AS toks FROM ep
      UNION ALL
      SELECT g.epoch, best.tok, list_append(g.toks, best.tok) FROM g JOIN best ON g.last = best.ctx AND g.epoch = best.epoch WHERE len(g.toks) < 32),
gs AS (SELECT epoch, array_to_string(arg_max(toks, len(toks)), ' ') AS sample FROM g GROUP BY epoch)
SELECT m.epoch, round(m.loss, 6) AS val_loss, round(exp(m.loss), 6) AS val_ppl,
       round(exp(m.loss * (cnt.n_tokens - 1) / (cnt.n_orig - 1)), 6) AS val_adjusted_ppl, gs.sample
FROM m JOIN gs ON m.epoch = gs.epoch CROSS JOIN cnt"""

DETECTOR = f"""corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 1 AS label, text FROM documents
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 0 AS label, text FROM conversations WHERE role = 'assistant'),
hd AS (SELECT id, label, list_distinct({tok('text')}) AS toks, substr(md5('42:' || regexp_replace(lower(trim(text)), '[\t-\r ]+', ' ', 'g')), 1, 1) AS h FROM corpus),
sd AS (SELECT id, label, toks, CASE WHEN h < '3' THEN 'test' WHEN h < '6' THEN 'valid' ELSE 'train' END AS split FROM hd),
ct AS (SELECT token, count(*) FILTER (label = 1) AS real, count(*) FILTER (label = 0) AS fake
       FROM (SELECT label, unnest(toks) AS token FROM sd WHERE split = 'train') GROUP BY token),
tt AS (SELECT sum(real) AS tr, sum(fake) AS tf, count(*) AS v FROM ct),
nn AS (SELECT count(*) FILTER (label = 1) AS nr, count(*) FILTER (label = 0) AS nf FROM sd WHERE split = 'train'),
grid AS (SELECT unnest([0.1, 1.0, 10.0])::DOUBLE AS a),
held AS (SELECT id, label, split, unnest(toks) AS token FROM sd WHERE split <> 'train'),
sums AS (SELECT id, label, a, sum(ln((coalesce(real, 0) + a) / (tr + a * (v + 1))) - ln((coalesce(fake, 0) + a) / (tf + a * (v + 1)))) AS s
         FROM held LEFT JOIN ct USING (token) CROSS JOIN tt CROSS JOIN grid GROUP BY id, label, a),
lg AS (SELECT sd.id, sd.label, sd.split, grid.a, ln((nr + 1) / (nf + 1)) + coalesce(s, 0) AS l
       FROM sd CROSS JOIN grid CROSS JOIN nn LEFT JOIN sums ON sums.id = sd.id AND sums.label = sd.label AND sums.a = grid.a WHERE sd.split <> 'train'),
m AS (SELECT a AS smoothing, avg(-ln(greatest(1.0 / (1.0 + exp(CASE WHEN label = 1 THEN -l ELSE l END)), 1e-15))) AS valid_loss,
             avg(CAST(CASE WHEN label = 1 THEN l > 0 ELSE l < 0 END AS INTEGER)) AS valid_acc FROM lg WHERE split = 'valid' GROUP BY a),
b AS (SELECT smoothing FROM m ORDER BY valid_loss, smoothing LIMIT 1)"""

ORACLE["D8_train_detector"] = f"WITH {DETECTOR} SELECT m.smoothing, round(valid_loss, 6) AS valid_loss, round(valid_acc, 6) AS valid_acc, m.smoothing = b.smoothing AS best FROM m, b"
ORACLE["D9_score_detector"] = f"""WITH {DETECTOR}
SELECT id, round(1.0 / (1.0 + exp(l)), 6) AS fake, round(1.0 / (1.0 + exp(-l)), 6) AS real, CASE WHEN label = 1 THEN l > 0 ELSE l < 0 END AS correct
FROM lg JOIN b ON lg.a = b.smoothing WHERE split = 'test'"""

ORACLE["D9_user_scorer"] = """WITH corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 1 AS label, text FROM documents
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 0 AS label, text FROM conversations WHERE role = 'assistant'),
l AS (SELECT id, label, ln(1 + length(text)) - 6.0 AS l FROM corpus)
SELECT id, label, round(1.0 / (1.0 + exp(l)), 6) AS fake, round(1.0 / (1.0 + exp(-l)), 6) AS real, CASE WHEN label = 1 THEN l > 0 ELSE l < 0 END AS correct FROM l"""

# D11 must equal the batch stand-in scorer (D10) on the same documents.
ORACLE["D11_incremental_score"] = ORACLE["D10_lexical_score"]
