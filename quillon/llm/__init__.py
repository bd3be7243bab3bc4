"""Operators for preparing training corpora on Spark.

Every operator takes a DataFrame, the names of the columns it should look at and
its own parameters, and selects those columns under private names first, so other
columns of the input, whatever they are called, never clash with its own.
"""
