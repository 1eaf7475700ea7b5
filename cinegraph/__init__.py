"""Analytics over films, people and the titles that link them, on Spark DataFrames."""
