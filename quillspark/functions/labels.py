"""Label and naming expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import _c

# Origin labels.
HUMAN_LABEL, HUMAN_TEXT = 1, "human-written"
MACHINE_LABEL, MACHINE_TEXT = 0, "machine-generated"


def origin_label(human: bool) -> tuple[Column, Column]:
    """(label, label_text) constants for one origin."""
    if human:
        return F.lit(HUMAN_LABEL).alias("label"), F.lit(HUMAN_TEXT).alias("label_text")
    return F.lit(MACHINE_LABEL).alias("label"), F.lit(MACHINE_TEXT).alias("label_text")


def decode_label(s) -> Column:
    """P3: 'human' -> 1, anything else (NULL included) -> 0."""
    return F.when(_c(s) == "human", 1).otherwise(0)


def split_alias(s) -> Column:
    """The caller's 'valid' is stored as 'val' in the news corpus."""
    return F.when(_c(s) == "valid", F.lit("val")).otherwise(_c(s))


def gen_method(model, top_p, top_k) -> Column:
    """P5: decode-setting name ``{model}_{code}``; an unknown setting fails the query."""
    p, k = _c(top_p), _c(top_k)
    code = (
        F.when((p == 0.96) & (k == 0), F.lit("p96"))
        .when((p == 1.0) & (k == 0), F.lit("p100"))
        .when((k == 40) & (p == 1.0), F.lit("k40"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown decode setting top_p="), p.cast("string"),
                                          F.lit(" top_k="), k.cast("string"))))
    )
    return F.concat(_c(model), F.lit("_"), code)


def bool_to_int(b) -> Column:
    """Boolean to 0/1 so that a mean is an accuracy."""
    return _c(b).cast("int")


def softmax_real(l_fake, l_real) -> Column:
    """Probability of 'real' from two logits, computed without overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(l_fake) - _c(l_real)))


def softmax_fake(l_fake, l_real) -> Column:
    """Probability of 'fake'."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(l_real) - _c(l_fake)))


def argmax_pred(l_fake, l_real) -> Column:
    """Predicted class (1 = real); ties go to class 0."""
    return F.when(_c(l_real) > _c(l_fake), 1).otherwise(0)


def correct_rule(fake, real, label) -> Column:
    """D3: (real>fake and label=1) or (fake>real and label=0); an exact tie is incorrect."""
    f, r, y = _c(fake), _c(real), _c(label)
    return ((r > f) & (y == 1)) | ((f > r) & (y == 0))
