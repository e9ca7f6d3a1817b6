"""Part of the deltarill engine."""
