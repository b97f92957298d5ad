"""Parsers that turn documents into links, fragments and visible text."""
