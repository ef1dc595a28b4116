"""Governance records, votes and documents as Spark DataFrame operators."""
