"""Bindings of the tables to roles, and the registered queries with their SQL."""
