"""Readers and writers; every table has an explicit schema."""
