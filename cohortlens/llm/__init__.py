"""Operators for training-data pipelines. ``catalog`` registers their queries; nothing else in the library imports this."""
