"""Readers, writers and input checks on any file system Spark can reach."""
