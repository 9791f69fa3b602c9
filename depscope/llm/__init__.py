"""Operators that prepare text corpora for model training.

Nothing outside this folder (and the pipeline script beside it) imports it.
"""
