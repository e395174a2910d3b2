"""Corpus folders, lists of addresses, note feeds, write-once sinks."""
