"""Cell-by-feature matrices and genomic intervals as Spark DataFrames."""
