from breathline.operators import distribution, imputation, joins, ordering, reshape, sampling, series, summaries

__all__ = [
    "distribution", "imputation", "joins", "ordering", "reshape", "sampling", "series", "summaries",
]
