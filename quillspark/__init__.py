"""Bibliographic data on Spark: text in, typed tables out."""
