"""Operators for preparing training text and vectors, with their queries; nothing else in the package uses them."""
