"""Vellum: Spark jobs for searching and maintaining collections of Markdown notes."""
