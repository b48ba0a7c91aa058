"""Files in, layers out."""
