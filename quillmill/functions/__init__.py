"""Column functions over text: character classes, widths and predicates."""
