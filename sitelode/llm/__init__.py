"""Operators for preparing training text at corpus scale.

Every operator takes and returns DataFrames, reads whole texts, and leaves unknown extra columns alone.
Nothing outside this package imports it.
"""
