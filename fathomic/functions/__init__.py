"""Scalar functions whose results and errors are part of the contract."""
