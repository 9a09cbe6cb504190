"""A PySpark engine for findings and source-corpus analytics."""
