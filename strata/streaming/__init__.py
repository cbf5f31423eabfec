"""The chart aggregates that make sense over an unbounded input."""
