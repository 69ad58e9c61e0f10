"""Operators over symbols, calls, chunks and answers."""
