"""SQL oracles for the token and sequence queries."""

from __future__ import annotations

from quillspark.functions.text import PY_SPACE
from quillspark.plans.oracle import ORACLE, tok

DT = f"dt AS (SELECT doc_id, {tok('text')} AS tokens FROM documents)"
VOCAB = DT + """,
cnt AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM dt) GROUP BY token),
vocab AS (
  SELECT token, CAST(3 + row_number() OVER (ORDER BY cnt DESC, token) AS BIGINT) AS id, CAST(cnt AS BIGINT) AS count
  FROM cnt WHERE cnt >= 2
  UNION ALL
  SELECT token, CAST(id AS BIGINT), CAST(count AS BIGINT)
  FROM (VALUES ('[PAD]', 0, 0), ('[UNK]', 1, 0), ('[CLS]', 2, 0), ('[SEP]', 3, 0)) r(token, id, count)),
ex AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM dt),
li AS (SELECT e.doc_id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids
       FROM ex e LEFT JOIN vocab v ON e.token = v.token GROUP BY e.doc_id),
ids AS (SELECT d.doc_id, coalesce(li.ids, []) AS ids FROM dt d LEFT JOIN li ON d.doc_id = li.doc_id)"""


def pad(ids: str, max_len: int = 128) -> str:
    h = f"list_slice({ids}, 1, {max_len})"
    return f"list_concat([2], {h}, [3], list_transform(range({max_len} - len({h})), lambda i: 0))"


def chunks(t: str, L: int) -> str:
    return (f"(CASE WHEN len({t}) < {L} THEN [{t}] ELSE "
            f"list_transform(range(len({t}) // {L}), lambda i: list_slice({t}, i * {L} + 1, i * {L} + {L})) END)")


LINES = """lines0 AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents),
lines1 AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN list_slice(ls, 1, len(ls) - 1) ELSE ls END AS ls FROM lines0),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_idx FROM lines1)"""

ORACLE["T1_tokenize"] = f"WITH {DT} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM dt"
ORACLE["T2_vocab"] = f"WITH {VOCAB} SELECT token, id, count FROM vocab"
ORACLE["T3_token_len"] = f"WITH {DT} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS text_len FROM dt"
ORACLE["T4_truncate"] = f"WITH {DT} SELECT doc_id, array_to_string(list_slice(tokens, 1, 128), ' ') AS text_trunc FROM dt"
ORACLE["J3_vocab_lookup"] = f"WITH {VOCAB} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids"
ORACLE["T5_special_pad"] = f"WITH {VOCAB} SELECT doc_id, array_to_string({pad('ids')}, ' ') AS token_ids_padded FROM ids"
ORACLE["T6_mask_ones"] = f"""WITH {VOCAB}
SELECT doc_id, array_to_string(list_transform({pad('ids')}, lambda x: 1), ' ') AS mask FROM ids"""
ORACLE["T7_mask_prefix"] = f"""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS url, len({tok('text')}) AS text_len FROM documents)
SELECT url, array_to_string(list_transform(range(130), lambda i: CASE WHEN i < text_len THEN 1 ELSE 0 END), ' ') AS mask
FROM n"""
ORACLE["T8_chunk"] = f"""WITH {DT}, c AS (SELECT doc_id, {chunks('tokens', 256)} AS ch FROM dt),
u AS (SELECT doc_id, unnest(ch) AS chunk, unnest(range(len(ch))) AS chunk_idx FROM c)
SELECT doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, CAST(len(chunk) AS BIGINT) AS n,
       array_to_string(chunk, ' ') AS text FROM u"""
ORACLE["F3_nonblank"] = f"""WITH {LINES}
SELECT doc_id, CAST(line_idx AS BIGINT) AS line_idx, line FROM lines WHERE regexp_matches(line, '[^{PY_SPACE}]')"""
ORACLE["T9_chunk_fast"] = f"""WITH {LINES}, nb AS (SELECT doc_id, line_idx, list_slice({tok('line')}, 1, 256) AS h
  FROM lines WHERE regexp_matches(line, '[^{PY_SPACE}]'))
SELECT doc_id, CAST(line_idx AS BIGINT) AS line_idx, CAST(len(h) AS BIGINT) AS n, array_to_string(h, ' ') AS text FROM nb"""
ORACLE["T10_caps"] = f"""WITH {LINES}, nb AS (
  SELECT doc_id, line_idx, len({chunks(f"list_slice({tok('line')}, 1, 64)", 4)}) AS n_chunks
  FROM lines WHERE regexp_matches(line, '[^{PY_SPACE}]')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS ti,
             coalesce(sum(n_chunks) OVER (PARTITION BY doc_id ORDER BY line_idx
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nb)
SELECT doc_id, CAST(line_idx AS BIGINT) AS line_idx, CAST(n_chunks AS BIGINT) AS n_chunks FROM r WHERE ti = 1 OR before < 3"""

LM_SPLIT = """sp AS (
  SELECT doc_id, text,
         CASE WHEN row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1
                   < floor(0.9 * count(*) OVER ()) THEN 'train' ELSE 'valid' END AS split
  FROM documents)"""

ORACLE["T11_corpus_counts"] = f"""WITH {LM_SPLIT},
w AS (SELECT split, {chunks(tok('text'), 256)} AS ch,
             len(string_split(regexp_replace(text, '\\A[{PY_SPACE}]+|[{PY_SPACE}]+\\z', '', 'g'), ' ')) AS orig FROM sp),
l0 AS (SELECT split, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM sp),
l1 AS (SELECT split, unnest(CASE WHEN ls[-1] = '' THEN list_slice(ls, 1, len(ls) - 1) ELSE ls END) AS line FROM l0),
l2 AS (SELECT split, len(string_split(line, ' ')) AS orig,
              CASE WHEN regexp_matches(line, '[^{PY_SPACE}]') THEN {chunks(tok('line'), 256)} END AS ch,
              CASE WHEN regexp_matches(line, '[^{PY_SPACE}]') THEN [list_slice({tok('line')}, 1, 256)] END AS fch FROM l1)
SELECT split, CAST(sum(list_sum(list_transform(ch, lambda c: len(c)))) AS BIGINT) AS n_tokens,
       CAST(sum(orig) AS BIGINT) AS n_original_tokens, CAST(sum(len(ch)) AS BIGINT) AS n_chunks, 'whole' AS mode
FROM w GROUP BY split
UNION ALL
SELECT split, CAST(coalesce(sum(list_sum(list_transform(ch, lambda c: len(c)))), 0) AS BIGINT),
       CAST(sum(orig) AS BIGINT), CAST(coalesce(sum(len(ch)), 0) AS BIGINT), 'line' FROM l2 GROUP BY split
UNION ALL
SELECT split, CAST(coalesce(sum(list_sum(list_transform(fch, lambda c: len(c)))), 0) AS BIGINT),
       CAST(sum(orig) AS BIGINT), CAST(coalesce(sum(len(fch)), 0) AS BIGINT), 'fast' FROM l2 GROUP BY split"""

ORACLE["T12_pad_batch"] = f"""WITH {VOCAB},
c AS (SELECT doc_id, {chunks('ids', 256)} AS ch FROM ids),
u AS (SELECT doc_id, unnest(ch) AS chunk, unnest(range(len(ch))) AS chunk_idx FROM c),
r AS (SELECT chunk, row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS row_idx FROM u),
b AS (SELECT *, row_idx // 4 AS batch_id, max(len(chunk)) OVER (PARTITION BY row_idx // 4) AS longest FROM r)
SELECT CAST(row_idx AS BIGINT) AS row_idx, CAST(batch_id AS BIGINT) AS batch_id,
       array_to_string(list_concat(chunk, list_transform(range(longest - len(chunk)), lambda i: 0)), ' ') AS ids FROM b"""

ORACLE["T13_model_window"] = f"""WITH {VOCAB}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS all_tokens, CAST(least(len(ids), 510) AS BIGINT) AS used_tokens,
       array_to_string(list_concat([2], list_slice(ids, 1, 510), [3]), ' ') AS ids FROM ids"""
