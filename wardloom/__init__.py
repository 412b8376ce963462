"""Clinical knowledge and training-case engine on Spark DataFrames."""
