"""Relational, graph and ledger operators over the store's tables."""
