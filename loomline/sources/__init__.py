"""Sources of loomline."""
