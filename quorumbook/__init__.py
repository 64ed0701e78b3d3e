"""Group-voting ledger analytics on Spark DataFrames."""
