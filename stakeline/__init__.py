"""Token delegation analytics on Spark DataFrames."""

from stakeline.config import Config
from stakeline.sources.tables import Tables

__all__ = ["Config", "Tables"]
