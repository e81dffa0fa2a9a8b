"""Column-wise cleaning and statistics over DataFrames."""
