"""Catalyst-expression forms of the scalar operators."""
