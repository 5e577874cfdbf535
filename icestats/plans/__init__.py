"""Plan-shaping helpers shared by the operators (slicing, ordering, quantiles)."""
