"""Trace readers and the parsers behind them."""
