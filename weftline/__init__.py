"""weftline: a Spark-native engine for ontology-based information extraction."""
