"""Normal distribution function and its inverse as column expressions.

Both use published rational approximations: W. J. Cody style complementary error function
(Numerical Recipes erfc, relative error below 1.2e-7) and P. J. Acklam's inverse (below 1.2e-9).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published approximations.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
CENTRAL_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01,
               2.506628277459239e00]
CENTRAL_BOTTOM = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00,
            2.938163982698783e00]
TAIL_BOTTOM = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL_SPLIT = 0.02425


def _polynomial(x: Column, falling: list[float]) -> Column:
    result = F.lit(falling[0])
    for coefficient in falling[1:]:
        result = result * x + F.lit(coefficient)
    return result


def normal_cdf(x: Column) -> Column:
    """P(Z <= x) for a standard normal Z."""
    z = F.abs(x) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.5)
    upper = t * F.exp(-z * z + _polynomial(t, ERFC[::-1])) * 0.5
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """Inverse of normal_cdf for p strictly between 0 and 1."""
    low_q = F.sqrt(F.log(p) * -2.0)
    high_q = F.sqrt(F.log(F.lit(1.0) - p) * -2.0)
    centre = p - 0.5
    square = centre * centre
    middle = centre * _polynomial(square, CENTRAL_TOP) / _polynomial(square, CENTRAL_BOTTOM)
    return (
        F.when(p < TAIL_SPLIT, _polynomial(low_q, TAIL_TOP) / _polynomial(low_q, TAIL_BOTTOM))
        .when(p > 1 - TAIL_SPLIT, -_polynomial(high_q, TAIL_TOP) / _polynomial(high_q, TAIL_BOTTOM))
        .otherwise(middle)
    )
