"""Payment-event analytics on PySpark: Bronze, Silver and Gold tables from a stream of JSON events."""
