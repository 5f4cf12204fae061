"""Operators of a training-data pipeline. Nothing else in corvane imports this subpackage."""
