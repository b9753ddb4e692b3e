"""DataFrame-in, DataFrame-out operators with caller-chosen keys and columns."""
