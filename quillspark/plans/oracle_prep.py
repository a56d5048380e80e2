"""SQL oracles for sampling, projection, filter and join queries."""

from __future__ import annotations

from quillspark.functions.text import PY_SPACE
from quillspark.plans.oracle import ESSAY, IDX, ORACLE, REVIEWS, essay_rows, tok
from quillspark.plans.oracle_tokens import LM_SPLIT, pad

PROMPTS = f"""p AS (SELECT doc_id, regexp_extract(text, '[^{PY_SPACE}]+', 0) AS prefix FROM documents
          WHERE regexp_extract(text, '[^{PY_SPACE}]+', 0) <> ''),
pr AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM p)"""

NEWS = """nw AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS url, d.source AS domain, d.text AS article,
         CASE (row_number() OVER (ORDER BY d.doc_id) - 1) % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split,
         CASE WHEN l.quality = 1 THEN 'human' ELSE 'machine' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

LAB = f"""lab AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text, 1 AS label, 'human-written' AS label_text FROM documents
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text, 0, 'machine-generated'
  FROM conversations WHERE role = 'assistant'),
lt AS (SELECT id, label, label_text, {tok('text')} AS tokens FROM lab)"""

ORACLE["L1_shuffle_split"] = f"WITH {LM_SPLIT} SELECT doc_id, split, CAST(42 AS BIGINT) AS seed FROM sp"
ORACLE["L2_sample_n"] = f"""WITH {LM_SPLIT} SELECT doc_id, split, CAST(43 AS BIGINT) AS seed FROM sp WHERE split = 'train'
ORDER BY md5('43:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 500"""
ORACLE["L3_position_split"] = """WITH u AS (
  SELECT 'human' AS origin, CAST(doc_id AS VARCHAR) AS id, doc_id AS k1, CAST(0 AS BIGINT) AS k2 FROM documents
  UNION ALL
  SELECT 'generated', CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), conv_id, turn FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY k1, k2) - 1 AS row_idx FROM u)
SELECT origin, id, row_idx,
       CASE WHEN row_idx < 300 THEN 'train' WHEN row_idx < 400 THEN 'valid' WHEN row_idx < 500 THEN 'test' ELSE 'unused' END AS split
FROM r"""
ORACLE["L4_range_shard"] = f"WITH {PROMPTS} SELECT doc_id, row_idx, row_idx // 100 AS shard FROM pr"
ORACLE["L5_mini_batch"] = f"WITH {PROMPTS} SELECT doc_id, row_idx // 10 AS batch_id, row_idx % 10 AS batch_pos FROM pr"
ORACLE["L6_epoch_order"] = f"""WITH {LM_SPLIT}, e AS (SELECT sp.doc_id, sp.split, t.epoch FROM sp, range(3) t(epoch))
SELECT split, epoch, doc_id, CAST(42 AS BIGINT) AS seed,
  CASE WHEN split = 'train'
       THEN row_number() OVER (PARTITION BY split, epoch
                               ORDER BY md5('42:' || CAST(epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id)
       ELSE row_number() OVER (PARTITION BY split, epoch ORDER BY doc_id) END - 1 AS pos
FROM e"""
ORACLE["L7_replica_shard"] = f"""WITH {LM_SPLIT},
t AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i
      FROM sp WHERE split = 'train'),
n AS (SELECT count(*) AS n FROM t),
pd AS (SELECT doc_id, i FROM t
       UNION ALL
       SELECT t.doc_id, t.i + n.n FROM t, n WHERE t.i < ((n.n + 6) // 7) * 7 - n.n)
SELECT doc_id, i % 7 AS replica, i // 7 AS slot, CAST(42 AS BIGINT) AS seed FROM pd"""
ORACLE["L8_sorted_groups"] = f"""WITH {REVIEWS}, g AS (SELECT urbanicity, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy
  FROM rev GROUP BY urbanicity)
SELECT urbanicity, accuracy, row_number() OVER (ORDER BY urbanicity) - 1 AS pos FROM g"""

ORACLE["P1_prefix"] = f"WITH {PROMPTS} SELECT doc_id, prefix FROM p"
ORACLE["P2_label_source"] = f"WITH {LAB} SELECT id, label, label_text FROM lab"
ORACLE["P3_label_decode"] = f"WITH {NEWS} SELECT url, CASE WHEN label = 'human' THEN 1 ELSE 0 END AS label_id FROM nw"
ORACLE["P4_split_alias"] = f"""WITH {NEWS}, c AS (SELECT split, count(*) AS n FROM nw GROUP BY split),
req AS (SELECT * FROM (VALUES ('train', 'train'), ('valid', 'val'), ('test', 'test')) v(requested, stored))
SELECT requested, stored, coalesce(c.n, 0) AS n FROM req LEFT JOIN c ON c.split = req.stored"""
ORACLE["P5_gen_method"] = """SELECT CASE conv_id % 3 WHEN 0 THEN 'gpt2_p96' WHEN 1 THEN 'gpt2_p100' ELSE 'gpt2_k40' END AS gen_method,
       count(*) AS n FROM conversations GROUP BY 1"""
ORACLE["P6_bool_to_int"] = f"WITH {ESSAY} SELECT filename, CAST(real > 0.94 AS INTEGER) AS correct FROM essay_sc"
ORACLE["P7_row_index"] = """SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS row_idx
FROM documents"""
ORACLE["P8_output_projection"] = f"""WITH {LAB},
cnt AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM lt) GROUP BY token),
vocab AS (SELECT token, 3 + row_number() OVER (ORDER BY cnt DESC, token) AS id FROM cnt WHERE cnt >= 2),
rows AS (SELECT id, label, list_slice(tokens, 1, 192) AS t FROM lt WHERE len(tokens) >= 192),
ex AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM rows),
li AS (SELECT e.id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids FROM ex e LEFT JOIN vocab v ON e.token = v.token
       GROUP BY e.id)
SELECT r.id, array_to_string({pad('li.ids', 192)}, ' ') AS token_ids,
       array_to_string(list_transform({pad('li.ids', 192)}, lambda x: 1), ' ') AS mask,
       r.label, array_to_string(r.t, ' ') AS text
FROM rows r JOIN li ON r.id = li.id"""

DOC_VOCAB = f"""dvt AS (SELECT {tok('text')} AS tokens FROM documents),
dvc AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM dvt) GROUP BY token),
vocab AS (SELECT token, 3 + row_number() OVER (ORDER BY cnt DESC, token) AS id FROM dvc WHERE cnt >= 2)"""


def prepared(rows: str, vocab: str, max_len: int, whole: bool) -> str:
    """``rows``: CTEs that end with ``rw`` (id, label, tokens)."""
    ones = f"list_transform({pad('ids', max_len)}, lambda x: 1)"
    mask = ones if whole else f"list_transform(range({max_len + 2}), lambda i: CASE WHEN i < n THEN 1 ELSE 0 END)"
    return f"""WITH {rows}, {vocab},
rt AS (SELECT id, label, len(tokens) AS n, list_slice(tokens, 1, {max_len}) AS t FROM rw {f'WHERE len(tokens) >= {max_len}' if whole else ''}),
ex AS (SELECT id, label, unnest(t) AS token, unnest(range(len(t))) AS pos FROM rt),
li AS (SELECT e.id, e.label, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids FROM ex e LEFT JOIN vocab v ON e.token = v.token GROUP BY e.id, e.label),
pd AS (SELECT r.id, r.label, r.n, r.t, coalesce(li.ids, []) AS ids FROM rt r LEFT JOIN li ON r.id = li.id AND r.label = li.label)
SELECT id, array_to_string({pad('ids', max_len)}, ' ') AS token_ids, array_to_string({mask}, ' ') AS mask, label, array_to_string(t, ' ') AS text FROM pd"""


ORACLE["P8_real_news"] = prepared(
    f"{NEWS}, rw AS (SELECT url AS id, CASE WHEN label = 'human' THEN 1 ELSE 0 END AS label, {tok('article')} AS tokens FROM nw WHERE split = 'val')", DOC_VOCAB, 192, False)
ORACLE["P8_school_reviews"] = prepared(f"""rv0 AS (SELECT 'doc/' || doc_id AS id, 1 AS label, text, doc_id AS k1, 0 AS k2 FROM documents
  UNION ALL SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 0, text, conv_id, turn FROM conversations WHERE role = 'assistant'),
rv1 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k1, k2) - 1 AS pos FROM rv0),
rw AS (SELECT id, label, {tok('text')} AS tokens FROM rv1 WHERE pos < 5000)""", DOC_VOCAB, 192, False)
ORACLE["P8_essays"] = prepared(f"""{IDX},
rw AS (SELECT i.filename AS id, 1 AS label, {tok('d.text')} AS tokens FROM idx i JOIN documents d ON i.filename = CAST(d.doc_id AS VARCHAR))""",
    """evc AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(list_slice(tokens, 1, 128)) AS token FROM rw WHERE len(tokens) >= 128) GROUP BY token),
vocab AS (SELECT token, 3 + row_number() OVER (ORDER BY cnt DESC, token) AS id FROM evc)""", 128, True)

ORACLE["T14_skip_tokens"] = """SELECT CAST(d.doc_id AS VARCHAR) AS id, 0 AS n_ids, 0 AS n_mask, 1 AS label, d.text
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
ORACLE["F1_min_tokens"] = f"""WITH {LAB} SELECT id, label, CAST(len(tokens) AS BIGINT) AS text_len FROM lt
WHERE len(tokens) >= 192"""
ORACLE["F2_split_filter"] = f"WITH {NEWS} SELECT url, split FROM nw WHERE split = 'train'"
ORACLE["F4_scored_only"] = "WITH " + essay_rows(0.94) + " SELECT filename, score_level, correct FROM essay_rows"
ORACLE["F5_level_pair"] = "WITH " + essay_rows(0.94) + """ SELECT filename, score_level, correct FROM essay_rows
WHERE score_level IN ('high', 'medium')"""
ORACLE["J1_index_body"] = f"""WITH {IDX}
SELECT i.filename, i.prompt, i.language, i.score_level, CAST(len({tok('d.text')}) AS BIGINT) AS text_len
FROM idx i JOIN documents d ON i.filename = CAST(d.doc_id AS VARCHAR)"""
ORACLE["J2_score_meta"] = f"""WITH {ESSAY}
SELECT i.filename, i.prompt, i.language, i.score_level, round(s.real, 6) AS real, s.real > 0.94 AS correct
FROM idx i JOIN essay_sc s ON i.filename = s.filename"""
ORACLE["J4_prompt_output"] = f"""WITH p AS (SELECT conv_id AS prompt_id, turn AS sample_idx, CAST(len({tok('text')}) AS BIGINT) AS prompt_tokens
  FROM conversations WHERE role = 'user'),
o AS (SELECT conv_id AS prompt_id, turn - 1 AS sample_idx, CAST(len({tok('text')}) AS BIGINT) AS output_tokens
  FROM conversations WHERE role = 'assistant')
SELECT p.prompt_id, p.sample_idx, p.prompt_tokens, o.output_tokens
FROM p JOIN o ON p.prompt_id = o.prompt_id AND p.sample_idx = o.sample_idx"""
ORACLE["J5_missing_body"] = "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"
ORACLE["U1_union_origin"] = f"WITH {LAB} SELECT id, label, label_text, CAST(len(tokens) AS BIGINT) AS text_len FROM lt"
