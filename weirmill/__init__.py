"""weirmill: a Spark-native engine for collections of crawled pages and text.

Every operator takes DataFrames and returns a DataFrame; nothing is executed until the caller acts.
"""
