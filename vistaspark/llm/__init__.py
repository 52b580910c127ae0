"""Operators for preparing large text corpora, written for Spark DataFrames."""
