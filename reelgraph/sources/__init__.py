"""File, vector-table and encoder sources and sinks."""
