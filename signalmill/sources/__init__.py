"""Inputs and outputs: export envelopes, the signal store, table adapters."""
