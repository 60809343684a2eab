"""Operators of a training-data pipeline and their registered queries; nothing else in the library imports this package."""
