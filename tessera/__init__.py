"""Tessera: a semantic analytics engine on PySpark."""
