"""Typed tables: schemas, scans, guarded reads, replacement and export."""
