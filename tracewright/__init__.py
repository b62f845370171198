"""Tracewright: agent traces to training records, declared as Spark plans."""

__version__ = "0.1.0"
