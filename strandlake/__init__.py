"""strandlake: a Spark-native engine for genomics tables and, in ``llm``, corpus preparation."""
