"""Readers: conversations by turn or by request, vocabularies, media."""
