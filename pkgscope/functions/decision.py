"""The decision on one scored package: tier, chances and the reason, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two priors of malware, the chance at which nothing is called clean, and the edge of a probability.
PRIOR_LOW, PRIOR_HIGH = 0.01, 0.10
SUSPICIOUS_CHANCE = 50.0
EDGE = 1e-4


def logit(p: Column) -> Column:
    x = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.ln(x / (1 - x))


def reweight(p: Column, base_rate: float, prior: float) -> Column:
    """Probability p learned at base_rate, restated for another prior by odds."""
    odds = p / F.greatest(1 - p, F.lit(EDGE)) * (prior / (1 - prior)) / (base_rate / (1 - base_rate))
    return odds / (1 + odds)


def assess(prob: Column, share: Column, capable: Column, cal: dict) -> dict[str, Column]:
    """tier, classifier_flags, similarity_flags, chance_low, chance_high.

    cal: base_rate, sim_flag, classifier_threshold, optional review_threshold, strict_threshold and
    capability_gate, and the calibrators ``both`` (on logit and share) and ``classifier_only`` (on
    logit), each with coef and intercept. A null share means that similarity was not available.
    """
    flag = prob >= cal["classifier_threshold"]
    review = prob >= cal.get("review_threshold", cal["classifier_threshold"])
    strict = prob >= cal.get("strict_threshold", 1.1)
    similar = F.coalesce(share >= cal["sim_flag"], F.lit(False))
    second = F.coalesce(capable, F.lit(True)) if cal.get("capability_gate") else similar | share.isNull()
    tier = F.when(strict | (flag & second), "malicious").when(flag | similar | review, "suspicious").otherwise("clean")
    both, alone = cal["both"], cal["classifier_only"]
    z = F.when(share.isNull(), alone["intercept"] + alone["coef"][0] * logit(prob)).otherwise(
        both["intercept"] + both["coef"][0] * logit(prob) + both["coef"][1] * share
    )
    chance = 1 / (1 + F.exp(-z))
    high = 100 * reweight(chance, cal["base_rate"], PRIOR_HIGH)
    return {
        "tier": F.when((tier == "clean") & (high >= SUSPICIOUS_CHANCE), "suspicious").otherwise(tier),
        "classifier_flags": flag,
        "similarity_flags": share >= cal["sim_flag"],
        "chance_low": 100 * reweight(chance, cal["base_rate"], PRIOR_LOW),
        "chance_high": high,
    }


# What a verdict rests on, and what is added for each way to reach it.
BASIS_BOTH, BASIS_ALONE = "classifier and code similarity", "classifier only (similarity unavailable)"
SAID = {
    "sure without capability": "; the classifier alone is confident enough, though no concrete capability was found",
    "flagged without capability": "; the score is high but no concrete malicious capability (code that runs by itself, a payload, exfiltration) was found, so review it",
    "review": "; below the classifier's alarm threshold but high enough to review",
    "similar only": "; the code resembles known malware, but the classifier does not flag it",
    "sure alone": "; the classifier alone is confident enough",
    "together": "; neither flags it alone, but together they lean malicious",
}


def basis(prob: Column, share: Column, capable: Column, cal: dict) -> Column:
    """What the verdict of assess() rests on, in words; cal as there."""
    made = assess(prob, share, capable, cal)
    flag = prob >= cal["classifier_threshold"]
    review = (prob >= cal.get("review_threshold", cal["classifier_threshold"])) & ~flag
    strict = prob >= cal.get("strict_threshold", 1.1)
    similar, able = F.coalesce(share >= cal["sim_flag"], F.lit(False)), F.coalesce(capable, F.lit(True))
    if cal.get("capability_gate"):
        why = F.when(strict & ~able, SAID["sure without capability"]).when(flag & ~able, SAID["flagged without capability"]).when(review, SAID["review"]).when(similar & ~flag, SAID["similar only"])
    else:
        why = F.when(strict & ~similar, SAID["sure alone"]).when(review & ~similar, SAID["review"])
    # Nothing flags it, yet it is not called clean: the chance alone says so.
    quiet = ~(flag | similar | review | strict)
    together = F.when(quiet & (made["tier"] == "suspicious"), SAID["together"]).otherwise("")
    return F.concat(F.when(share.isNull(), BASIS_ALONE).otherwise(BASIS_BOTH), F.coalesce(why, F.lit("")), together)


def policies(prob: Column, capable: Column, f05: float, fpr1: float, fpr05: float, strict: float) -> dict[str, Column]:
    """The seven decision policies as predicates."""
    sure = prob >= strict
    return {
        "model @F0.5": prob >= f05,
        "model @1% FPR": prob >= fpr1,
        "model @0.5% FPR": prob >= fpr05,
        "hard gate @1% FPR": (prob >= fpr1) & capable,
        "soft gate @1% / strict": ((prob >= fpr1) & capable) | sure,
        "soft gate @F0.5 / strict": ((prob >= f05) & capable) | sure,
        "soft gate @0.5% / strict": ((prob >= fpr05) & capable) | sure,
    }
