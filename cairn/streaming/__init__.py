"""Structured Streaming forms of the operators: state that a stream of writes, beats or messages leaves."""
