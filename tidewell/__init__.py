"""A PySpark-native engine for collecting, labelling, matching and reporting on channel text."""
