"""seqspark: sequence, gene-structure and start-site analytics as Spark DataFrames."""
