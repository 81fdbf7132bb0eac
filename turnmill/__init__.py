"""Dialogue-corpus analytics expressed as Spark plans."""
