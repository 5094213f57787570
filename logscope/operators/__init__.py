"""Operators: lazy ``DataFrame -> DataFrame`` functions over log tables."""
