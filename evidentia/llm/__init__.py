"""Operators of a training-data pipeline: each module holds one operator, ``queries.py`` registers them."""

import pyarrow

# Python workers are reused by later tasks: freed batches go back to the system at once.
pyarrow.set_memory_pool(pyarrow.system_memory_pool())
