"""Operators on text corpora, registered as queries ``opN_<name>``."""
