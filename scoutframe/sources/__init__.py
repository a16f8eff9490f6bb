"""File, HTML and nested-item sources, and sinks."""
