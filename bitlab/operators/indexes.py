"""Scalar indexes of structured complexity from measured shares, as column expressions.

Weights and class limits are fixed values of the definitions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the structured complexity index.
SCI_WEIGHTS = {"hierarchy": 0.35, "causality": 0.40, "nontriviality": 0.25}
#: Upper limits of classes.
TRANSFER = ((0.1, "weak"), (0.3, "moderate"), (0.6, "strong"))
NONTRIVIAL = ((0.2, "trivial"), (0.4, "low"), (0.6, "moderate"), (0.8, "high"))
SCI = ((0.2, "low"), (0.4, "moderate"), (0.6, "good"), (0.8, "high"))
ICC = ((0.1, "very low"), (0.25, "low"), (0.4, "moderate"), (0.6, "good"), (0.8, "high"))


def nontriviality(lz: Column, diversity: Column) -> Column:
    """1 at a normalised LZ complexity of a half, 0 at 0 and 1, times the share of possible patterns that occur."""
    return (1 - F.abs(2 * lz - 1)) * diversity


def sci(hierarchy: Column, causality: Column, nontrivial: Column, weights: dict[str, float] = SCI_WEIGHTS) -> Column:
    """The structured complexity index: a weighted sum."""
    return weights["hierarchy"] * hierarchy + weights["causality"] * causality + weights["nontriviality"] * nontrivial


def icc(compressibility: Column, coherence: Column, hierarchy: Column, criticality: Column, phi: Column | None = None) -> Column:
    """The coherence index: root of the first two, times hierarchy and criticality, up to a fifth more by ``phi``, at most 1."""
    base = F.sqrt(compressibility * coherence) * hierarchy * criticality
    return F.least(F.lit(1.0), base if phi is None else base * (1 + F.greatest(phi, F.lit(0.0)) * 0.2))


def class_of(value: Column, limits: tuple[tuple[float, str], ...], above: str) -> Column:
    """The name of the first limit that ``value`` is below, else ``above``."""
    out = F.when(value < limits[0][0], limits[0][1])
    for limit, name in limits[1:]:
        out = out.when(value < limit, name)
    return out.otherwise(above)


def criticality(hurst: Column, slope: Column) -> Column:
    """How near a fluctuation exponent is to 0.85 and a spectral slope to -1: the mean of both, 1 at best."""
    by_hurst = F.when(hurst <= 1.1, 1 - F.abs(hurst - 0.85) / 0.85).otherwise(0.5)
    return (by_hurst + (1 - F.abs(slope + 1) / 2)) / 2


def normalised_lz(phrases: Column, n: Column) -> Column:
    """Phrases over n / log2(n), at most 1; 0 for fewer than two symbols."""
    return F.when(n > 1, F.least(F.lit(1.0), phrases * F.log2(n.cast("double")) / n)).otherwise(0.0)


#: Weights of the structural emergence index and of the edge index.
SEI_WEIGHTS = {"order": 0.3, "hierarchy": 0.3, "coherence": 0.2, "non_randomness": 0.2}
ECI_WEIGHTS = {"criticality": 0.25, "complexity": 0.25, "coherence": 0.2, "hierarchy": 0.15, "fluctuation": 0.15}
#: Upper limits of classes.
LZ = ((0.1, "very low"), (0.3, "low"))
INFORMATION = ((0.01, "none"), (0.05, "weak"), (0.1, "moderate"))
EMERGENCE = ((0.3, "low"), (0.5, "moderate"), (0.7, "high"))
EDGE = ((0.3, "far"), (0.5, "approaching"), (0.7, "near"))


def lz_class(lz: Column) -> Column:
    """Class of a normalised LZ complexity."""
    return class_of(lz, (*LZ, (0.7000000001, "structured")), "high")


def slope_class(slope: Column) -> Column:
    """Class of a spectral slope."""
    return F.when(slope.between(-1.2, -0.8), "1/f").when(slope > -0.3, "white").when(slope < -1.5, "brownian").otherwise("intermediate")


def scores(lz: Column, hierarchy: Column, mean_entropy: Column, information: Column, hurst: Column, slope: Column) -> dict[str, Column]:
    """The scores, each within 0 and 1, that both indexes weigh.

    order: 1 less LZ; complexity: best for LZ within 0.3 and 0.7; criticality: best for a slope of -1; coherence: ten times the mean mutual
    information; hierarchy: twice the variation of normalised block entropies, less where their mean is below 0.3 or above 0.9;
    fluctuation: best for an exponent within 0.85 and 1.1 (0 for null); non_randomness: the mean of how far exponent and slope are from those of noise.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    penalty = F.when(mean_entropy < 0.3, mean_entropy / 0.3).when(mean_entropy > 0.9, (1 - mean_entropy) / 0.1).otherwise(1.0)
    fluctuation = F.when(hurst.isNull(), 0.0).when(hurst > 1.1, F.greatest(zero, 1 - (hurst - 1.1) / 0.4)).when(hurst >= 0.85, 1.0).when(hurst >= 0.6, 0.6 + (hurst - 0.6) / 0.25 * 0.4).otherwise(F.greatest(zero, hurst))
    persistent = F.coalesce(F.greatest(zero, (hurst - 0.5) * 2), zero)
    falling = F.when(slope < 0, F.greatest(zero, F.least(one, -slope))).otherwise(0.0)
    return {
        "order": 1 - lz,
        "complexity": F.when(lz <= 0.3, 0.7 + lz / 0.3 * 0.3).when(lz <= 0.7, 1.0).otherwise(F.greatest(zero, 1 - (lz - 0.7) / 0.3)),
        "criticality": F.greatest(zero, 1 - F.abs(slope + 1) / 2),
        "coherence": F.least(one, information * 10),
        "hierarchy": F.least(one, hierarchy * 2) * penalty,
        "fluctuation": fluctuation,
        "non_randomness": (persistent + falling) / 2,
    }


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum of those ``parts`` that have weights."""
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + w * parts[k]
    return out
