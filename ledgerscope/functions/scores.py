"""Scores as columns, in decimals, with ties to even.

Confidence and score stay apart: missing evidence lowers confidence alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import fixed_values as V
from ledgerscope.functions.text import contains_any


def weight(axis: Column) -> Column:
    """Weight of an axis as a decimal."""
    table = F.create_map(*(F.lit(x) for pair in V.AXIS_WEIGHTS.items() for x in pair))
    return (table[axis] / F.lit(100)).cast("decimal(4,2)")


def gap_severity(axis: Column, score: Column, confidence: Column) -> Column:
    """What a gap costs: missing points times weight times confidence, to two places."""
    return F.bround((F.lit(100) - score).cast("decimal(6,2)") * weight(axis) * confidence.cast("decimal(5,2)"), 2)


def is_actionable(confidence: Column) -> Column:
    return confidence * 100 >= V.ACTIONABLE_CONFIDENCE


def change_kind(new_evidence: Column, score_change: Column, confidence_change: Column) -> Column:
    """Kind of change of an axis between two runs (confidence in hundredths): absence of evidence is never regression."""
    return (
        F.when(new_evidence > 0, "nova_evidencia")
        .when((confidence_change < -V.CONFIDENCE_NOISE) & (score_change <= 0), "confianca_caiu")
        .when((score_change > V.SCORE_NOISE) & (confidence_change >= -V.CONFIDENCE_NOISE), "melhorou")
        .when((score_change < -V.SCORE_NOISE) & (confidence_change >= -V.CONFIDENCE_NOISE), "piorou")
        .otherwise("estavel")
    )


def source_trust(kind: Column, age_days: Column) -> Column:
    """Trust of a source in ten-thousandths: base by kind, decayed by age; no date, no decay."""
    base = F.create_map(*(F.lit(x) for pair in V.SOURCE_TRUST.items() for x in pair))[kind]
    decay = F.when(age_days.isNull(), 100)
    for days, share in V.TRUST_DECAY:
        decay = decay.when(age_days <= days, share)
    return base * decay.otherwise(V.TRUST_OLD)


def noisy_or(trusts: Column) -> Column:
    """Joint confidence of the five most trusted sources (an array of doubles); 0 for none."""
    top = F.slice(F.reverse(F.array_sort(trusts)), 1, V.TRUST_TOP)
    return F.round(1 - F.aggregate(top, F.lit(1.0), lambda left, t: left * (1 - t)), 4)


def funding_signal(announced: Column, today: Column) -> Column:
    """Freshness of a round: linear within the window, nothing outside, 0.3 if undated."""
    age = F.datediff(today, announced) / F.lit(V.DAYS_PER_MONTH)
    return F.when(announced.isNull(), 0.3).when((age < 0) | (age > V.FUNDING_MONTHS), 0.0).otherwise(1 - age / V.FUNDING_MONTHS)


def founder_signal(backgrounds: Column) -> Column:
    """1 with a technical founder, 0 without any founder or with one known not to be, 0.3 where nothing is known."""
    known = F.filter(backgrounds, lambda b: b.isNotNull())
    return F.when(F.coalesce(F.size(backgrounds), F.lit(0)) == 0, 0.0).when(F.array_contains(known, True), 1.0).when(F.size(known) == 0, 0.3).otherwise(0.0)


def hiring_signal(roles: Column) -> Column:
    """1 with a machine-learning role, 0.4 with any role."""
    named = F.exists(roles, lambda r: contains_any(F.lower(r), V.HIRING_WORDS))
    return F.when(F.coalesce(named, F.lit(False)), 1.0).when(F.size(roles) > 0, 0.4).otherwise(0.0)


def stage_signal(stage: Column) -> Column:
    table = F.create_map(*(F.lit(x) for name, n in V.STAGE_SCORES.items() for x in (name, n / 100)))
    return F.coalesce(F.try_element_at(table, stage), F.lit(V.STAGE_SCORES[V.UNKNOWN] / 100))


def capacity(funding: Column, founder: Column, hiring: Column, stage: Column) -> Column:
    """Weighted signals (three places each) within 0 and 1, to three places with ties to even."""
    w = V.CAPACITY_WEIGHTS
    parts = ((funding, "funding"), (founder, "founder"), (hiring, "hiring"), (stage, "stage"))
    total = sum(signal.cast("decimal(6,3)") * F.lit(w[name]).cast("decimal(3,0)") for signal, name in parts)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.bround(total / 100, 3).cast("double")))


def capacity_told(funding: Column, founder: Column, hiring: Column, stage: Column) -> Column:
    """What a capacity is made of, in words: each signal with its weight."""
    parts = {"funding": funding, "founder": founder, "hiring": hiring, "stage": stage}
    return F.concat_ws(", ", *(F.format_string(f"{V.CAPACITY_LABELS[name]} %.2f (peso {V.CAPACITY_WEIGHTS[name]}%%)", F.bround(signal.cast("decimal(9,6)"), 2).cast("double")) for name, signal in parts.items()))


def capacity_rationale(capacity_to_act: Column, told: Column, risk: Column, confidence: Column) -> Column:
    """Why a company is as urgent as it is."""
    two = lambda c: F.bround(c.cast("decimal(9,4)"), 2).cast("double")
    return F.format_string("Capacidade de agir %.2f — %s. Urgência = risco %.0f × capacidade %.2f × confiança %.2f.", two(capacity_to_act), told, F.bround(risk.cast("decimal(9,4)"), 0).cast("double"), two(capacity_to_act), two(confidence))


def bucket(total: Column, confidence: Column, capacity_to_act: Column, maturity: Column) -> Column:
    return (
        F.when((F.coalesce(maturity, F.lit("")) == "indeterminado") | (confidence < V.MIN_GLOBAL_CONFIDENCE), "monitorar")
        .when(total >= V.DEFENSIBLE_TOTAL, "case_potencial")
        .when(capacity_to_act >= V.CAPACITY_CUT, "abordar_agora")
        .otherwise("nutrir")
    )


def urgency(risk: Column, capacity_to_act: Column, confidence: Column) -> Column:
    """Risk times capacity times confidence, within 0 and 100; a product that is a double's error below a tie counts as the tie."""
    product = risk * capacity_to_act * F.greatest(confidence, F.lit(0.1))
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), product)) * 10) / 10
