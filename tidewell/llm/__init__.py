"""Operators for text corpora: encoding, packing and repetition. Nothing outside this folder imports it."""
