"""Operators for preparing audited document texts as training data. Nothing outside this folder imports it."""
