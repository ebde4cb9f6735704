"""Typed values of the language: coding systems, durations, codelists."""
