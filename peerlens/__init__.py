"""Peer comparison on Spark: filings in, one metric table and its reports out."""
