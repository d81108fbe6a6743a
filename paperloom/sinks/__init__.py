"""Sinks: tables to files and reports."""
