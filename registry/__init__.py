"""Registered queries and the SQL each must agree with."""
