"""Prototype selection and data preparation as Spark jobs."""
