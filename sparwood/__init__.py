"""sparwood: a Spark-native engine for habitat scouting and large tabular and text corpora."""
