"""Readers and writers: tables, forum views, snapshots."""
