"""Transcript segmentation and detection as Spark DataFrame operators."""
