"""Packed data of one field to numbers and back. Numpy only; Spark calls these on Arrow batches."""
