"""Schema-change impact analytics on Spark DataFrames.

Every operator is a function from DataFrames to DataFrames.  ``run_key`` (one
change set) is part of every join and grouping key, so thousands of change sets
are diffed, traced and scored in one job.
"""

__version__ = "0.1.0"
