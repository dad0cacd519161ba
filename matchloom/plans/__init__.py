"""Queries over the test tables and the help that sessions need."""
