"""Operators of a training-data pipeline: ten DataFrame jobs over document tables.

Nothing else in ``athletrack`` imports this subpackage.
"""
