"""Spectral analytics and corpus operators as Spark jobs."""
