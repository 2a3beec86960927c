"""Column functions: names, geography, spectra."""
