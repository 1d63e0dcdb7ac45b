"""Operators for the texts that language models are trained on. Nothing outside imports this package."""
