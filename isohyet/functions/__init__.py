"""Scalar functions as Column expressions; nothing here runs Python on executors."""
