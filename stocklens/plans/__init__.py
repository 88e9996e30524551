"""Composition of operators into the retail job and the registered queries."""
