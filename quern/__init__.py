"""quern: measures collections of files and records with Spark DataFrames."""
