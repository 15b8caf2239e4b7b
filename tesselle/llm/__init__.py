"""Operators of a training-data pipeline: cleaning, deduplication, tokenising, packing.

Nothing outside this folder imports it, and it imports nothing of the library.
"""
