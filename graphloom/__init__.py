"""graphloom: graph-embedding analytics and corpus operators on Spark DataFrames."""
