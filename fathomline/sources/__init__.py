"""Table schemas, file and database readers, report text, sinks and test bindings."""
