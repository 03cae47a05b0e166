"""Column helpers and shared distributed building blocks."""

from storelens.functions.sizing import broadcast_if_bounded, cut_lineage
from storelens.functions.quantile import exact_quantiles

__all__ = ["broadcast_if_bounded", "cut_lineage", "exact_quantiles"]
