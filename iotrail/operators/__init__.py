"""Relational operators: ordered scans, pairing, attribution, aggregation."""
