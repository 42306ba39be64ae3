"""Training-data operators; nothing else in meldframe imports this subpackage."""
