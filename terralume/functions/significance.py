"""The chi-squared distribution with four degrees of freedom, in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DOF = 4


def survival(t) -> Column:
    """P(X > t): (1 + t/2) exp(-t/2)."""
    t = F.col(t) if isinstance(t, str) else t
    return (1.0 + t / 2.0) * F.exp(-t / 2.0)


def survival_values(t):
    """The same of a numpy array."""
    import numpy as np

    return (1.0 + t / 2.0) * np.exp(-t / 2.0)


def survival_value(t: float) -> float:
    return (1.0 + t / 2.0) * math.exp(-t / 2.0)


def quantile_value(p: float) -> float:
    """t with survival p, by Newton's method; computed once on the driver and used as a literal."""
    t = max(1.0, -2.0 * math.log(p))
    for _ in range(100):
        step = (survival_value(t) - p) / (t / 4.0 * math.exp(-t / 2.0))
        t += step
        if abs(step) < 1e-13 * t:
            break
    return t


MEDIAN = quantile_value(0.5)


def neg_log10(t, cap: float | None = 20.0) -> Column:
    """-log10 of the survival, floored at 1e-300 and capped unless ``cap`` is None."""
    p = -F.log10(F.greatest(survival(t), F.lit(1e-300)))
    return p if cap is None else F.least(p, F.lit(cap))
