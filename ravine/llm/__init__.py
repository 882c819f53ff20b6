"""Training-data operators: sharding, archives, token files, deduplication, mixing, filtering.

Every operator takes a DataFrame and returns one; nothing else in ``ravine`` imports this
subpackage. ``queries`` applies each operator to its whole table.
"""
