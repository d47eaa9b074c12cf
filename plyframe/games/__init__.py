"""Rules of small boards as plug-ins over the shared plans."""
