"""Training-data operators. Nothing else in the library imports this package.

``queries`` (in :mod:`lakeloom.llm.registry`) lists the driver queries; each operator has its own module.
"""
