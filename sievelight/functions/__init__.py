"""Part of sievelight; see the README for the map of modules."""
