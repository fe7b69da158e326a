"""Arithmetic of elements, scalar functions and scans."""
