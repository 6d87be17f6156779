"""Operators of a training-data pipeline: tokenisation, filtering,
near-duplicate removal, packing.  Nothing outside this subpackage imports it."""
