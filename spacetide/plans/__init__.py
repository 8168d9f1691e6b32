"""Registered queries: each reads the driver tables and exercises one operator."""
