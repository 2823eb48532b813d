"""tapewright: option-tape analytics written for Spark DataFrames.

Every operator takes DataFrames and parameters and returns a DataFrame.
"""
