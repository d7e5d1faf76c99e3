"""crosswind: daily cross-sectional factor research on PySpark DataFrames."""
