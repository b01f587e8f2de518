"""Operators for building training corpora; nothing else in brindle imports this subpackage."""
