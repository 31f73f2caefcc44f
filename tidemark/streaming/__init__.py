"""Running indicators over streams."""

from .running import running_ema, running_sum

__all__ = ["running_ema", "running_sum"]
