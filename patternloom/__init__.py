"""patternloom: event-pattern queries on Spark DataFrames."""
