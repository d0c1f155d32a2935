"""Tessera: retrieval, knowledge-graph and learner analytics on Spark DataFrames."""
