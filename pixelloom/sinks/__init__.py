"""Encoders of pixel tables and images as terminal text."""
