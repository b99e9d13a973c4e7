"""A Spark-native analytics engine for activity logs of agents."""
