"""Column expressions: periods, keys, money, prices, comparisons."""
