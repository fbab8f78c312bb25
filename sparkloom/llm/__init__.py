"""Training-data operators: formatting, quality, archives, de-duplication, secrets, language and mixing."""
