"""millrace: a PySpark-native analytics engine over typed entities, event
tables, JSON documents and their change feeds."""
