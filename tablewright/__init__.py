"""Tablewright: turns transcribed business documents into tables that can be trusted, on Spark."""
