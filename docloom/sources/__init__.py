"""Readers and writers of label, OCR, vocabulary, archive and training files."""
