"""DataFrame in, DataFrame out: window, join, set and chart-data operators."""
