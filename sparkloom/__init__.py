"""sparkloom: a Spark-native engine for building, measuring and searching documentation corpora."""
