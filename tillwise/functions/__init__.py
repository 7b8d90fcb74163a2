"""Column-level building blocks: numeric coercion, money sums, exact quantiles, scalar attach."""

from tillwise.functions.numeric import coerce_double, money_sum, nan_to_null, round_stat
from tillwise.functions.quantiles import bin_by_edges, exact_quantiles, quantile_edges
from tillwise.functions.scalars import attach_scalars

__all__ = [
    "coerce_double", "money_sum", "nan_to_null", "round_stat",
    "exact_quantiles", "quantile_edges", "bin_by_edges", "attach_scalars",
]
