"""SQL oracles for the reader / writer round trips (the expected rows, derived directly)."""

from __future__ import annotations

from quillspark.functions.text import NOT_PRINTABLE
from quillspark.plans.oracle import ESSAY, IDX, ORACLE, REVIEWS, tok, ttr
from quillspark.plans.oracle_prep import LAB, NEWS
from quillspark.plans.oracle_tokens import LM_SPLIT, pad

GEN = """g AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text,
         CASE conv_id % 3 WHEN 0 THEN 'gpt2_p96' WHEN 1 THEN 'gpt2_p100' ELSE 'gpt2_k40' END AS gen_method,
         row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx FROM conversations),
gs AS (SELECT *, CASE row_idx % 10 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split,
              row_idx // 100 AS shard FROM g)"""

_ESC = "replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_CODE = """CASE WHEN unicode(c) < 256 THEN '\\x' || lpad(lower(to_hex(unicode(c))), 2, '0')
     WHEN unicode(c) < 65536 THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0')
     ELSE '\\U' || lpad(lower(to_hex(unicode(c))), 8, '0') END"""
_BODY = f"""array_to_string(list_transform(regexp_extract_all({_ESC}, '(?s).'),
     lambda c: CASE WHEN regexp_matches(c, '[{NOT_PRINTABLE}]') THEN {_CODE} ELSE c END), '')"""
REPR = f"""CASE WHEN strpos(text, '''') > 0 AND strpos(text, '"') = 0 THEN '"' || {_BODY} || '"'
     ELSE '''' || replace({_BODY}, '''', '\\''') || '''' END"""


def digest(c: str = "text") -> str:
    return f"CAST(length({c}) AS BIGINT) AS n_chars, md5({c}) AS text_md5"


ORACLE["S1_reviews_csv"] = f"""WITH {REVIEWS}
SELECT rev.url, d.text AS review_text, round(rev.singleparent_share2010, 6) AS singleparent_share2010,
       round(rev.perwht, 6) AS perwht, rev.urbanicity
FROM rev JOIN documents d ON rev.url = 'doc/' || CAST(d.doc_id AS VARCHAR)"""
ORACLE["S2_index_csv"] = f"WITH {IDX} SELECT filename, prompt, language, score_level FROM idx"
ORACLE["S3_whole_text"] = f"SELECT CAST(doc_id AS VARCHAR) AS filename, {digest()} FROM documents"
ORACLE["S4_jsonl_real"] = f"SELECT CAST(doc_id AS VARCHAR) AS id, true AS ended, {digest()} FROM documents"
ORACLE["K1_jsonl_sink"] = f"WITH {GEN} SELECT gen_method, split, shard, id, {digest()} FROM gs"
ORACLE["S5_jsonl_shards"] = f"WITH {GEN} SELECT gen_method, split, shard, id, {digest()} FROM gs WHERE split = 'valid'"
ORACLE["F6_file_prefix"] = f"WITH {GEN} SELECT id, split FROM gs WHERE split LIKE 'val%'"
ORACLE["S6_jsonl_news"] = f"WITH {NEWS} SELECT url, split, label, {digest('article')} FROM nw WHERE split = 'val'"
ORACLE["S7_json_array"] = f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, {digest()}
FROM conversations"""
ORACLE["S8_json_map"] = f"""WITH {ESSAY}
SELECT filename AS id, round(fake, 6) AS fake, round(real, 6) AS real, real > fake AS correct FROM essay_sc"""
ORACLE["K2_result_sink"] = ORACLE["S8_json_map"]
ORACLE["K3_text_sink"] = f"WITH {LM_SPLIT} SELECT split, {REPR} AS line FROM sp"
ORACLE["S9_text_corpus"] = f"""WITH {LM_SPLIT}
SELECT split, count(*) AS n_lines, CAST(sum(length({REPR}) + 1) AS BIGINT) AS n_chars FROM sp GROUP BY split"""
ORACLE["S10_format_dispatch"] = f"""WITH t AS (SELECT text, {REPR} AS line FROM documents),
f AS (SELECT unnest(['parquet', 'json', 'csv', 'text']) AS format, unnest([text, text, text, line]) AS t FROM t)
SELECT format, count(*) AS n_rows, CAST(sum(length(t)) AS BIGINT) AS n_chars,
       CAST(sum(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT)) AS BIGINT) AS text_sum FROM f GROUP BY format"""
ORACLE["K4_prepared_sink"] = f"""WITH {LAB},
cnt AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM lt) GROUP BY token),
vocab AS (SELECT token, 3 + row_number() OVER (ORDER BY cnt DESC, token) AS id FROM cnt WHERE cnt >= 2),
rows AS (SELECT id, label, label_text, list_slice(tokens, 1, 192) AS t FROM lt WHERE len(tokens) >= 192),
ex AS (SELECT id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM rows),
li AS (SELECT e.id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids FROM ex e LEFT JOIN vocab v ON e.token = v.token
       GROUP BY e.id)
SELECT r.id, r.label, r.label_text, array_to_string({pad('li.ids', 192)}, ' ') AS token_ids,
       array_to_string(r.t, ' ') AS text,
       CASE WHEN r.label = 1 THEN 'human' ELSE 'gpt2_p100' END AS gen_method,
       CASE WHEN substr(md5('42:' || r.id), 1, 1) < 'd' THEN 'train' ELSE 'test' END AS split
FROM rows r JOIN li ON r.id = li.id"""
