"""Operators for training-data text. Nothing outside this folder imports it."""
