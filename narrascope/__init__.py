"""Spark toolkit for incident-narrative analytics: DataFrame in, DataFrame out."""
