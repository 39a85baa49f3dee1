"""Operators of a training-data pipeline (see README, section "llm").

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
