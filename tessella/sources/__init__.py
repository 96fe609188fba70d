"""Readers and writers of feature collections, annotation files, tile inventories and reports."""
