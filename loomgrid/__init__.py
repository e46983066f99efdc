"""loomgrid: a PySpark-native engine for declarative data-processing graphs."""

__version__ = "0.1.0"
