"""Spark-native analytics over corpora of heterogeneous tables.

Subpackages: ``sources`` (readers, sinks, scratch storage), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame), ``plans`` (registered queries and
their SQL), ``streaming`` and, optional and imported by nothing else, ``llm``.
"""
