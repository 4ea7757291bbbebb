"""Operators over DataFrames that are more than one built-in call."""
