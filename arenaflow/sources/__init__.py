"""Readers of match records, archives and snapshots. No network: remote sources are represented by the files they would give."""
