"""Pileup analytics on Spark: aligned reads to variant tables, as DataFrame plans."""
