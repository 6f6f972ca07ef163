"""Scalar expressions: values, filters, features and the level-skip rule."""
