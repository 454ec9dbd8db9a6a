"""Readers, and the shared folder for cut lineage."""
