"""wordmosaic: mining near-duplicate and spatially related items from bags of visual words, on Spark."""

__version__ = "0.1.0"
