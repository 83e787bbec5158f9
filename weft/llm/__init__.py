"""Operators for large-scale training-data pipelines; nothing else in weft imports this package."""
