"""Card decision engine on Spark DataFrames: cleaning, rules, label transfer, scoring and output contracts."""
