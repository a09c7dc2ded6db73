"""Scalar expressions and driver-side helpers."""
