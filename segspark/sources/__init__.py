"""Readers and writers of text formats, as DataFrames."""
