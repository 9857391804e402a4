"""Annotation, signal and detection analytics expressed as Spark DataFrame plans."""
