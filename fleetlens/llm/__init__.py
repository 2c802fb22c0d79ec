"""Preparing training text: near-duplicates, quality, toxicity, mixing, tokens and more.

Every operator takes and returns DataFrames.  Nothing outside this package imports it.
"""
