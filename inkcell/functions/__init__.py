"""Column functions: braille cells, encoding, decoding, tagging, text."""
