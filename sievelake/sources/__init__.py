"""Readers and writers of landed files: JSON, JSONL, HTML cards, and a versioned table of postings."""
