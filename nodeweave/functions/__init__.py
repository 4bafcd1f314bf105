"""Part of nodeweave; see the README."""
