"""Scalar functions: every one takes and returns Columns and stays in generated code."""
