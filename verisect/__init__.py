"""Accuracy of genomic variants, intervals and read alignments as Spark DataFrame jobs."""
