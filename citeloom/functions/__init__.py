"""Scalar functions: hashed uniforms, scores, bins and list encodings."""
