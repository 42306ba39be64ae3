"""meldframe: replicated, conflict-free tables as Spark DataFrames."""
