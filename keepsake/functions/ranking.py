"""Ranking functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.schema import HALF_LIVES, INITIAL_CONFIDENCE, RRF_K, STATUS_FACTORS, TRUST_FACTORS


def _choice(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def trust_factor(trust: Column) -> Column:
    return _choice(trust, dict(enumerate(TRUST_FACTORS)), 0.5)


def initial_confidence(trust: Column) -> Column:
    return _choice(trust, dict(enumerate(INITIAL_CONFIDENCE)), 0.5)


def half_life(kind: Column) -> Column:
    """Days; null where nothing decays."""
    return _choice(kind, HALF_LIVES, None).cast("double")


def _age(now: Column, then: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400.0


def effective_confidence(confidence: Column, kind: Column, anchor: Column, now: Column) -> Column:
    """Confidence halved for every half-life since the anchor; without an anchor, and before it, as it is."""
    age = _age(now, anchor)
    return F.when(half_life(kind).isNull() | age.isNull() | (age <= 0), confidence).otherwise(confidence * F.pow(F.lit(2.0), -age / half_life(kind)))


def anchors(columns) -> tuple[Column, Column]:
    """Since when confidence and recency fade: the last confirmation, else the last update, and for confidence else the making; of the columns there are."""
    there = lambda *names: F.coalesce(*[F.col(n) for n in names if n in columns], F.lit(None).cast("timestamp"))
    return there("last_confirmed_at", "updated_at", "created_at"), there("last_confirmed_at", "updated_at")


def recency(kind: Column, anchor: Column, now: Column) -> Column:
    """0.3 + 0.7 times a halving that is linear between whole half-lives."""
    x = _age(now, anchor) / half_life(kind)
    decay = F.pow(F.lit(2.0), -F.floor(x)) * (1 - 0.5 * (x - F.floor(x)))
    return F.when(x.isNull() | (x <= 0), 1.0).otherwise(0.3 + 0.7 * decay)


def confidence_multiplier(effective: Column, status: Column) -> Column:
    return (0.5 + 0.5 * effective) * _choice(status, STATUS_FACTORS, 1.0)


def reciprocal_rank(*ranks: Column) -> Column:
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1.0 / (RRF_K + r), F.lit(0.0))
    return out


def factors(importance: Column, trust: Column, kind: Column, confidence: Column, status: Column, anchor: Column, now: Column, recent: Column | None = None) -> dict[str, Column]:
    """What a score is multiplied by, part by part; recency goes by ``recent`` where that is not the anchor of confidence."""
    eff = effective_confidence(confidence, kind, anchor, now)
    return {"importance": 0.6 + 0.1 * importance, "trust": trust_factor(trust), "recency": recency(kind, anchor if recent is None else recent, now), "confidence": confidence_multiplier(eff, status)}


def modulated(base: Column, importance: Column, trust: Column, kind: Column, confidence: Column, status: Column, anchor: Column, now: Column, recent: Column | None = None) -> Column:
    f = factors(importance, trust, kind, confidence, status, anchor, now, recent)
    return base * f["importance"] * f["trust"] * f["recency"] * f["confidence"]


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where the lengths differ or either is zero."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)
