"""Operators that take several steps or change the shape of a table."""

from .averages import ema, ema_in_blocks, rsi, rsi_in_blocks
from .blur import gaussian_blur, gaussian_weights
from .grouping import apply_for_axis, bincount, bincount_ranges, group_rows, padded_groups, reduce_nan_patterns, skipna, skipna_values, stable_sort
from .linalg import eigh, einsum, nanpca, orthogonalize, orthonormalize, pca, pca_cov, project
from .long_series import (
    bfill_in_blocks,
    cumcount_in_blocks,
    cumulative_in_blocks,
    ffill_in_blocks,
    nancumprod_in_blocks,
    rcummax_in_blocks,
    rcumsum_in_blocks,
    scan_in_blocks,
    trailing_in_blocks,
    with_blocks,
)
from .near import wide_gaussian_blur, wide_rci
from .ranges import with_places
from .randoms import rand_table, randint_table, randn_table, randperm, with_permuted, with_rand, with_randn
from .soft_topk import soft_topk, soft_topk_bottomk
from .subspace import pca_top
from .wide import wide_bollinger_band, wide_ma, wide_mmax, wide_mmin, wide_moments, wide_mstd, wide_msum, wide_mvar

__all__ = [name for name in dir() if not name.startswith("_")]
