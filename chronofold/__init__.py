"""A time-series feature engine on the Spark DataFrame API."""

from chronofold.extract import extract_features
from chronofold.settings import DynamicGroupBySettings, ExtractionSettings, FeatureSetting

__all__ = ["DynamicGroupBySettings", "ExtractionSettings", "FeatureSetting", "extract_features"]
