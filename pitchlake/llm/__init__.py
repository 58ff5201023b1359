"""Operators of a training-data pipeline: near-duplicates, scans, scores, mixing.

Nothing outside this folder imports it.
"""
