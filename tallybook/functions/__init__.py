"""Scalar functions: hashes, quantizers, sizes."""
