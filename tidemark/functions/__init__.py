"""Column builders: each operator that one expression can say."""

from .moving import bollinger_band, ma, mmax, mmin, msum, mstd, mvar, rci
from .reductions import (
    correl,
    covar,
    mulmean,
    mulsum,
    nancorrel,
    nancovar,
    nankurtosis,
    nanmax,
    nanmean,
    nanmin,
    nanmulmean,
    nanmulsum,
    nanskew,
    nanslope,
    nansum,
    nanvar,
    rms,
    slope,
)
from .scans import bfill, cumcount, ffill, group_shift, nancumprod, nancumsum, nanshift, rcummax, rcumsum, shift, stable_rank
from .scalars import fillna, hash62, nanones, rand, randint, randn, signif

__all__ = [name for name in dir() if not name.startswith("_")]
