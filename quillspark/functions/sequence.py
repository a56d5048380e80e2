"""Fixed-length sequence preparation over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import _c


def truncate(toks, max_len: int) -> Column:
    """T4: first ``max_len`` tokens."""
    return F.slice(_c(toks), 1, max_len)


def truncated_text(toks, max_len: int) -> Column:
    """T4: text rebuilt from the first ``max_len`` tokens."""
    return F.array_join(truncate(toks, max_len), " ")


def special_pad(ids, max_len: int, cls_id: int, sep_id: int, pad_id: int = 0) -> Column:
    """T5: [CLS] + first max_len ids + [SEP], right-padded with ``pad_id`` to exactly max_len+2."""
    head = F.slice(_c(ids), 1, max_len)
    return F.concat(
        F.array(F.lit(cls_id)),
        head,
        F.array(F.lit(sep_id)),
        F.array_repeat(F.lit(pad_id), F.lit(max_len) - F.size(head)),
    )


def mask_ones(ids) -> Column:
    """All-ones mask of the same length."""
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def mask_prefix(text_len, max_len: int) -> Column:
    """mask[i] = 1 for i < min(max_len+2, text_len); text_len excludes the special tokens."""
    ones = F.least(F.greatest(_c(text_len), F.lit(0)), F.lit(max_len + 2))
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), F.lit(max_len + 2) - ones))


def chunks(toks, seq_len: int) -> Column:
    """One short chunk when len < seq_len (also for empty), else floor(len/seq_len) full chunks."""
    t = _c(toks)
    n = F.size(t)
    full = F.transform(
        F.sequence(F.lit(0), (n / F.lit(seq_len)).cast("int") - 1),
        lambda i: F.slice(t, i * seq_len + 1, seq_len),
    )
    return F.when(n < seq_len, F.array(t)).otherwise(full)


def chunk_count(n, seq_len: int) -> Column:
    """Chunks of a list of ``n`` items."""
    return F.when(_c(n) < seq_len, F.lit(1)).otherwise((_c(n) / F.lit(seq_len)).cast("int"))


def head_chunk(toks, seq_len: int) -> Column:
    """Fast mode keeps only the first ``seq_len`` tokens of a line."""
    return F.slice(_c(toks), 1, seq_len)


def model_window(ids, model_max: int, begin_id: int, end_id: int) -> Column:
    """First model_max-2 ids framed by begin/end markers."""
    return F.concat(F.array(F.lit(begin_id)), F.slice(_c(ids), 1, model_max - 2), F.array(F.lit(end_id)))


def used_tokens(ids, model_max: int) -> Column:
    """How many ids of the text the model window keeps."""
    return F.least(F.size(_c(ids)), F.lit(model_max - 2))
