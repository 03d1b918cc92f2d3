"""Spark-first engine for building, cleaning, auditing and querying typed knowledge graphs."""
