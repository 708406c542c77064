"""Spark-native engine for cutting long documents into narration segments and tracking their rendering."""
