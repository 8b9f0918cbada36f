"""factloom: evidence-grounded analytics over company reports, on Spark DataFrames."""
