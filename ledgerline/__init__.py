"""Ledgerline: company-filings analytics as PySpark DataFrame and SQL plans."""
