"""A PySpark-native engine for grounded question-and-answer datasets."""
