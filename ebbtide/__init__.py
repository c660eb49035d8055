"""A change-data-capture engine for versioned lakehouse tables on Spark DataFrames."""
