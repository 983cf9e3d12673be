"""Readers and writers: notes, JSON lines, prediction log, artifacts, reports."""
