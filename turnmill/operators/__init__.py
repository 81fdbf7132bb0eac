"""Relational operators of the dialogue model, DataFrame in and DataFrame out."""
