"""Queries over the test tables, each with the SQL that it must agree with."""
