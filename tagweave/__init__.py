"""Tag recommendation, text-graph analytics and corpus preparation on PySpark DataFrames."""
