"""penduline: a Spark-native engine for manifest algebra, evaluation planning and trajectory analytics."""

__version__ = "0.1.0"
