"""Operators for training-data pipelines.

Each module holds one operator; ``queries`` registers the ``opN_*`` queries
over the driver's tables. Nothing outside this folder imports it.

Conventions shared by all operators: they read the columns they name, so
extra columns (also ones called like an output) are ignored; a null text
counts as the empty text; rows are never dropped, capped or sampled; an
empty input gives an empty output with the same schema.
"""
