"""Operators of a training-data pipeline. Nothing else in quillon imports this subpackage."""
