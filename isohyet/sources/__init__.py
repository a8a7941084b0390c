"""Text and columnar sources, and sinks."""
