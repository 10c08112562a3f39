"""Part of lintweave."""
