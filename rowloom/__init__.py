"""A PySpark engine for columnar log data."""
