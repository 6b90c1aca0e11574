"""The query language: syntax tree, parser, compiler."""
