"""DataFrame operators over documents: line regrouping, replacement rules, concatenation."""
