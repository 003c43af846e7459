"""Training-data operators: deduplication, filtering, scoring and tokenizing at corpus scale.

Every module holds one operator with its own general interface; ``queries`` has the
thin ``opN_<name>`` queries that apply them to whole tables.
"""
