"""Phonetic term memory and batch term resolution on PySpark."""
