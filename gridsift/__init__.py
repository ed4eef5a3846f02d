"""Site-suitability screening over gridded and vector data, on Spark DataFrames."""

__version__ = "0.1.0"
