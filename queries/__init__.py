"""Registered queries and their SQL counterparts, one module per operator family."""
