"""Operators of a training-data pipeline: near duplicates, tokenizer output,
quality, packing, search and filters. Nothing else in the library imports
this subpackage."""
