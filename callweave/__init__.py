"""Spark jobs over archives of recorded phone calls."""
