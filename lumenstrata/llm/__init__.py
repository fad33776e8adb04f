"""Operators for training-data pipelines.

Each module holds one operator with its general interface; ``queries`` maps
the operators onto the driver's tables.  Nothing outside this subpackage
imports it.
"""
