"""Operators for building large text corpora, one module for each operator."""
