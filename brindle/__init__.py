"""Corpus, retrieval, decision and live-signal analytics on Spark DataFrames."""
