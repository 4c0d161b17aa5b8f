"""Readers of SAM, FASTA, FASTQ, VCF and truth tables."""
