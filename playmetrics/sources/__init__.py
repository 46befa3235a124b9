"""Readers, writers and the views the queries run on."""
