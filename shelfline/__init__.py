"""shelfline: catalogue tracking and price-history analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
