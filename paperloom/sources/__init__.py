"""Files as tables: reading, detection and decoding."""
