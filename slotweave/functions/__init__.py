"""Part of slotweave."""
