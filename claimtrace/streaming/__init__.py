"""Streaming operators: streaming DataFrames in, a streaming DataFrame out; the caller picks the sink."""
