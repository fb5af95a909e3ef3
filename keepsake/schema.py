"""Tables, enumerations and constants of the belief store."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = ("fact", "preference", "decision", "event", "note")
STATUSES = ("active", "superseded", "tombstoned", "quarantined", "aging")
TRUST_FACTORS = (1.0, 0.97, 0.90, 0.75)
INITIAL_CONFIDENCE = (1.0, 0.95, 0.80, 0.50)
#: Days until a claim's confidence halves; types that are not listed never decay.
HALF_LIVES = {"event": 90, "note": 180, "fact": 540}
STATUS_FACTORS = {"aging": 0.6, "superseded": 0.4, "quarantined": 0.4, "tombstoned": 0.25}
RRF_K, AGING_BELOW, RECALL_LIMIT = 60, 0.35, 8
DUPLICATE, ENTITY_FLOOR, SUBJECT_FLOOR, AMBIGUOUS = 0.93, 0.55, 0.38, 0.82
SHINGLE, SHORT_SHINGLE = 6, 3

MEMORY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("importance", T.IntegerType()),
        T.StructField("trust", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("last_confirmed_at", T.TimestampType()),
        T.StructField("scope", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("superseded_by", T.LongType()),
    ]
)
