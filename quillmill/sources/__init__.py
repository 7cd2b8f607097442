"""Reading files in mixed encodings, and writing text files."""
