"""Chains of stages, and the operators as registered queries."""
