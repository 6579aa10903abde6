"""Training-data operators: ten corpus-scale building blocks written as Spark jobs.

Nothing else in the library imports this subpackage.
"""
