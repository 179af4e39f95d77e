"""Readers that turn tables, Git history and source trees into DataFrames."""
