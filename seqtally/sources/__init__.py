"""Readers and writers of the text formats the operators work on."""
