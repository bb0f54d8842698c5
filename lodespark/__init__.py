"""lodespark: a PySpark-native engine for dataset discovery, graph, literature and evaluation queries."""
