"""Operators on streams, tables of samples, identities, spectra and evaluations."""
