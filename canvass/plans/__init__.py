"""Shared plans: one-pass aggregates, ranks, weights and row scopes."""
