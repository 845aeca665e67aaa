"""Authorship forensics and corpus analytics over whole corpora, on PySpark."""
