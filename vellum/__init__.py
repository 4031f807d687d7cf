"""Spark-native engine for evidence-first document analytics.

Every operator is a function from DataFrames to a DataFrame.  Plans stay lazy
until a caller acts on them; the only eager steps are checkpoints of iterative
algorithms and the fitting of models on bounded samples.
"""

__version__ = "0.1.0"
