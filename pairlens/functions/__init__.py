from .bounded import bounded
from .expressions import asinh_odd, flag, in_set, mask_draw, md5_key, normal_cdf, seeded_draw, seeded_uniform
from .ranking import exact_quantiles, hash_cutoff, hash_rank, ranked_counts

__all__ = [
    "asinh_odd",
    "bounded",
    "exact_quantiles",
    "flag",
    "hash_cutoff",
    "hash_rank",
    "in_set",
    "mask_draw",
    "md5_key",
    "normal_cdf",
    "ranked_counts",
    "seeded_draw",
    "seeded_uniform",
]
