"""Marketplace analytics on Spark: column functions, DataFrame operators, sources and sinks, streams, registered plans."""
