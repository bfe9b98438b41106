"""ledgerloom: a Spark-first engine for review logs, recommendation tasks and training data.

Layers: ``sources`` (tables, files, durable intermediates), ``functions``
(Column helpers), ``operators`` (DataFrame operators), ``plans`` (registered
queries with their SQL), ``streaming`` (Structured Streaming twins) and the
optional subpackage ``llm``, which nothing else here imports.
"""

__version__ = "0.1.0"
