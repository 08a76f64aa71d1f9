"""Tombolo: mutable keyed datasets as append-only changelogs, computed by Spark."""
