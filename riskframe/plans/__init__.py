"""Whole analyses composed of operators, and the query catalogue on the supplied tables."""
