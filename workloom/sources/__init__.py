"""Readers and writers: tables, message streams, dead letters, log lines and JSON export."""
