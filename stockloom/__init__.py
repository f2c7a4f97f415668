"""Retail supply-chain analytics as functions from DataFrames to DataFrames."""
