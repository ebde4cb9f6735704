"""Declared tables as their sources hold them, before anything is chosen or cleaned."""
