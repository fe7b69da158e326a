"""Operators over entry tables (row, col, val): products, sums, access, order, layout and checks."""
