"""Deferred chains: recording, pairing, checking, rewriting and rendering. Nothing here reads data."""
