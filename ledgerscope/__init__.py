"""Ledgerscope: financial-crime forensics over settled payments, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
