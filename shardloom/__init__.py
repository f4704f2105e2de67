"""shardloom: a Spark-native engine for preparing and analysing token corpora.

Text tables become an ordered token stream, packed into fixed-size shards,
labelled training / validation / testing, cut into input/target windows and
dealt to ranks; a distributed next-token count model, seeded top-k generation
and training-run telemetry analytics sit on top.  Every operator is a
DataFrame -> DataFrame function; see README.md for the inventory.
"""

__version__ = "0.1.0"
