"""Spark-first genotyping and phasing of a polyploid individual with two sub-genomes."""
