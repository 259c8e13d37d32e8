"""Feature and label engine for trade tapes, expressed with Spark DataFrames."""
