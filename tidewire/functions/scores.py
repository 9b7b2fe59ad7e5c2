"""Scores, bands, tiers, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import values


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + 0.5)


def band(score: Column) -> Column:
    """Label of a score's band."""
    out = F.lit(values.LOWEST_BAND)
    for least, label in reversed(values.BANDS):
        out = F.when(score >= least, label).otherwise(out)
    return out


def tier(score: Column) -> Column:
    """0 for the top tier to 4."""
    return F.when(score >= 90, 0).when(score >= 80, 1).when(score >= 70, 2).when(score >= 60, 3).otherwise(4)


def tier_bound(tier_no: Column, which: int) -> Column:
    """Lowest (0) or highest (1) score of a tier."""
    return F.element_at(F.array(*[F.lit(t[which]) for t in values.TIERS]), tier_no + 1)


def spread(rank: Column, size: Column, low: Column, high: Column) -> Column:
    """The rank-th (from 0) of ``size`` scores spread evenly from high to low; a single one is in the middle."""
    return F.when(size <= 1, half_up((low + high) / 2)).otherwise(high - half_up(rank * (high - low) / F.greatest(size - 1, F.lit(1)))).cast("long")


def sub_scores(impact: Column, facts: Column, novelty: Column, fallback: Column) -> Column:
    """Sum of the parts, rounded and capped at 40, 30 and 30; the fallback if all are missing."""
    part = lambda c, cap: F.least(half_up(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))), F.lit(cap))
    missing = impact.isNull() & facts.isNull() & novelty.isNull()
    return F.when(missing, fallback).otherwise(part(impact, 40) + part(facts, 30) + part(novelty, 30)).cast("long")


def capped(score: Column, derivative: Column, clickbait: Column, incident: Column) -> Column:
    """Ceilings of derivative pieces (72) and clickbait (79) only lower; incidents are exempt."""
    low = F.when(derivative, F.least(score, F.lit(72))).otherwise(score)
    return F.when(incident, score).otherwise(F.when(clickbait, F.least(low, F.lit(79))).otherwise(low))


def tag_values(*arrays: Column) -> Column:
    """Distinct trimmed lower-case tags without generic ones."""
    flat = F.array_distinct(F.transform(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]), lambda v: F.lower(F.trim(v))))
    return F.filter(flat, lambda v: (v != "") & ~v.isin(values.GENERIC_TAGS))


def canonical(name: Column, aliases: Column) -> Column:
    """Canonical name by a map from lower-case aliases; empty on a miss."""
    return F.coalesce(F.try_element_at(aliases, F.lower(F.trim(name))), F.lit(""))


def canonical_tags(names: Column, aliases: Column, most: int = 3) -> Column:
    """Canonical, distinct, without misses, at most three."""
    return F.slice(F.array_distinct(F.filter(F.transform(names, lambda n: canonical(n, aliases)), lambda n: n != "")), 1, most)
