"""Population event-rate analytics on Spark DataFrames.

``functions``  column expressions with explicit missing-data rules
``sources``    sheet exports in, indexed CSV out
``operators``  DataFrame -> DataFrame building blocks
``plans``      whole analyses composed from the operators
"""
