"""Audit, privacy and reconciliation operators."""
