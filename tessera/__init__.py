"""Tessera: document, matching and usage analytics written on the Spark DataFrame API."""
