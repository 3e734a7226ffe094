"""Conversation and transcript analytics on Spark DataFrames."""
