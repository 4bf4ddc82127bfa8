"""corpuskit: PySpark-native search, linking and curation of large document corpora."""
