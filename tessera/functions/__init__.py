"""Scalar functions as Column builders, with the semantics the engine documents."""
