"""strongroom: integrity analytics for large media and document archives on Spark.

Every operator takes DataFrames and returns DataFrames; see README.md for the map.
"""
