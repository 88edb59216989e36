"""Scalar column functions: vectors, colours, kernels."""
