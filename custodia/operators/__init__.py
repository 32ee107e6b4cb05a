"""Governance operators: checks, classification, protection, catalog, lineage, certification."""
