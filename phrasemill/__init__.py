"""phrasemill: corpus linguistics on Spark DataFrames."""
