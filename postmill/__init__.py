"""Mail-data jobs for PySpark: tables and streams in, tables and streams out."""
