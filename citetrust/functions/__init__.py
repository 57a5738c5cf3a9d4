"""Column to Column functions: wikitext, registrable domains, probability vectors."""
