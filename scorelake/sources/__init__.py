"""Readers and writers of run outputs, datasets, registries and label sheets."""
