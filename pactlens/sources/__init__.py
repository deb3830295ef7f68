"""Readers that turn recorded traffic, specifications and code into rows."""
