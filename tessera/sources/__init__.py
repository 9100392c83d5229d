"""Tables, logs, files and packs."""
