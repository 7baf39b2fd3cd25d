"""Code-health analytics and corpus preparation on Spark DataFrames."""
