"""chunkloom: tagged binary containers and the relational patterns around them, on Spark DataFrames."""
