"""A PySpark engine for time-indexed cross-sectional panels: formulas, metrics, as-of joins, stores and search."""
