"""Part of strataq."""
