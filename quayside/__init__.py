"""Resource-aware batch selection and corpus preparation on Spark DataFrames."""
