"""weftline: a PySpark-native engine for auditing design vocabularies and preparing text corpora."""
