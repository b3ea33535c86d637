"""Operators for building training corpora: mixing, sharding, duplicates, decontamination, redaction, counts, languages.

Every operator reads only the columns it names (other columns, whatever they are called, are ignored or carried along
untouched), and states in its docstring what it does with nulls, empty texts, repeated rows and empty tables.
"""
