"""From programs to lazy DataFrames: running, checking, describing and translating them."""
