"""Marram: a Spark-native engine for retrieval, relationship analytics and consistency audits over corpora."""
