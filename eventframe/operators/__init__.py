"""Operators: DataFrame -> DataFrame building blocks, grouped by the survey's operator families."""
