"""Spark-native analytics for two-sided dated events.

Every public operator takes DataFrames and returns a DataFrame; none of them
triggers a Spark action unless its docstring says so.
"""
