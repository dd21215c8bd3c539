"""mortar: a Spark-native engine for honest regression studies on tabular data.

Layout
------
sources/    scans and sinks (mix view, dirty CSV scan, result tables, manifests)
functions/  Column-expression builders (name cleaning, coercion, features, hashing, metrics)
operators/  DataFrame -> DataFrame operators (groups, splits, stats, Gram fitting, CV,
            trees, kNN, stacking, augmentation, tuning, leaderboards, scoring)
plans/      fixtures derived from the driver tables and the query catalog
streaming/  Structured Streaming scoring
"""

__version__ = "0.1.0"
