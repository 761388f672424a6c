"""Detection analytics on Spark DataFrames: preparation, selection, kernels, models, metrics and triage."""
