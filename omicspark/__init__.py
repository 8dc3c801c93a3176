"""Quantitative-omics analytics as Spark jobs: every operator takes and returns DataFrames."""
