"""Scan assembly and monitoring: batch forms and their streaming twins."""
