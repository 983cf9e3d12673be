"""End-to-end jobs composed of operators."""
