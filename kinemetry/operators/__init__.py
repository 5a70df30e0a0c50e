"""Operators over ordered flags, models, spectra and rankings."""
