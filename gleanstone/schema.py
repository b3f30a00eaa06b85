"""The canonical record and the artefacts derived from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanstone.functions.calendar import real_canonical
from gleanstone.functions.text import first_of, is_blank

VERDICTS = T.ArrayType(T.StructType([T.StructField("criterion", T.StringType()), T.StructField("passed", T.BooleanType())]))
COUNTS = ("latency_ms", "input_tokens", "output_tokens", "cost_micro_usd")
TEXTS = ("input_text", "output_text", "feedback", "error")
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "ts_utc", "input_text", "output_text", "prompt_version", "arm")]
    + [T.StructField(n, T.LongType()) for n in COUNTS]
    + [T.StructField(n, T.StringType()) for n in ("error", "feedback")]
    + [T.StructField("judge_verdicts", VERDICTS)]
)
FIELDS = tuple(RECORD.fieldNames())
SIGNALS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("weight", T.IntegerType()), T.StructField("evidence", T.StringType())]))


def record_fault() -> Column:
    """The first invariant that a row of record columns breaks, or null.

    Blank is not null: an optional text is absent or has content. Exactly one of output and
    error is there; counts aren't negative; no criterion is judged twice.
    """
    col = F.col
    optional = ("output_text", "prompt_version", "arm", "error", "feedback")
    verdicts = F.coalesce(col("judge_verdicts"), F.array().cast(VERDICTS))
    criteria = F.transform(verdicts, lambda v: v["criterion"])
    return first_of(
        (is_blank(col("record_id")) | col("record_id").rlike(r"[\r\n]"), "record_id"),
        (~real_canonical(col("ts_utc")), "ts_utc"),
        (is_blank(col("input_text")), "input_text"),
        *[(col(c).isNotNull() & is_blank(col(c)), c) for c in optional],
        *[(col(c) < 0, c) for c in COUNTS],
        (col("output_text").isNull() == col("error").isNull(), "outcome"),
        (F.exists(verdicts, lambda v: is_blank(v["criterion"]) | v["passed"].isNull()), "verdict"),
        (F.size(F.array_distinct(criteria)) < F.size(criteria), "verdict_twice"),
        otherwise=F.lit(None).cast("string"),
    )


def canonical_json() -> Column:
    """A record as one line of JSON with sorted keys, nulls included."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(FIELDS)]), {"ignoreNullFields": "false"})
