"""Secret detection over container images and other content, and the tables around it, on Spark DataFrames."""
