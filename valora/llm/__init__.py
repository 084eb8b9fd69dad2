"""Training-data operators; nothing else in ``valora`` imports this package."""
