"""scoreloom: Spark-native analytics over corpora of music scores.

Layers: ``sources`` (readers, parsers of raw files), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (named queries
and their SQL twins), ``streaming`` (stateful operators), ``llm`` (training-data
operators, optional: nothing outside it imports it).
"""
