"""Marketplace product research on Spark: DataFrame in, DataFrame out."""

from shelfsight.config import ScoreConfig, SizeLimits
from shelfsight.session import configure

__all__ = ["ScoreConfig", "SizeLimits", "configure"]
