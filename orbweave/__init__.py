"""Spark-native N-body analytics: octrees, interaction lists and fast summation over DataFrames."""
