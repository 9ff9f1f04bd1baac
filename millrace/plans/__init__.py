"""Reusable plan shapes that stay balanced when one key is very large."""
