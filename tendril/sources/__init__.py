"""Landing of payloads, delimited files and pages as typed tables, and sinks."""
